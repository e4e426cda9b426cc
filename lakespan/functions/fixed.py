"""Fixed values of the detection rules: keyword sets, patterns, thresholds and weights."""

from __future__ import annotations

#: Keywords of each document class (a document counts at most five of a class).
DOCTYPE_KEYWORDS = {
    "court": [
        "affidavit", "allegation", "appeal", "appellant", "appellee", "arraignment", "bailiff", "brief", "case", "civil", "complaint", "counsel",
        "counterclaim", "court", "criminal", "damages", "defendant", "deposition", "discovery", "docket", "evidence", "exhibit", "filing",
        "grievance", "hearing", "indictment", "injunction", "judge", "judgment", "jurisdiction", "jury", "litigation", "magistrate", "motion",
        "oath", "objection", "order", "petition", "petitioner", "plaintiff", "plea", "pleading", "precedent", "ruling", "statute", "subpoena",
        "summons", "testimony", "verdict", "writ",
    ],
    "medical": [
        "admission", "allergy", "anatomy", "anesthesia", "anesthesiologist", "antibiotic", "antibody", "antigen", "assessment", "bacteria",
        "biochemistry", "biopsy", "blood pressure", "cancer", "carcinoma", "cardiologist", "cardiology", "cardiovascular", "chart", "clinic",
        "clinician", "dermatologist", "diagnosis", "discharge", "dna", "dosage", "dose", "emergency", "endocrine", "endocrinologist", "enzyme",
        "epidemiology", "examination", "fracture", "gastroenterologist", "gastrointestinal", "gene", "geneticist", "gland", "gynecologist",
        "hematologic", "hematologist", "hepatic", "history", "hormone", "hospital", "imaging", "immune", "immunologist", "immunology", "infection",
        "infectious", "inflammation", "injection", "inpatient", "intake", "laboratory", "lesion", "lymph", "malignant", "medication", "metabolic",
        "microbiology", "muscle", "musculoskeletal", "neonatologist", "neoplasm", "nephrologist", "neurological", "neurologist", "nurse",
        "obstetrician", "oncologist", "oncology", "operative", "ophthalmologist", "organ", "orthopedics", "orthopedist", "otolaryngologist",
        "outpatient", "pathology", "patient", "pediatrician", "pharmacology", "pharmacy", "physician", "physiology", "podiatrist", "prescription",
        "procedure", "progress note", "protein", "psychiatrist", "pulmonary", "pulmonologist", "radiologist", "radiology", "referral", "refill",
        "renal", "respiratory", "rheumatologist", "soap note", "specimen", "surgeon general", "surgery", "symptom", "syndrome", "tablet", "therapy",
        "tissue", "toxicology", "treatment", "triage", "tumor", "urologist", "vaccine", "virus", "vital signs", "vitals", "vitamin", "ward",
    ],
    "financial": [
        "account", "accrual", "amount", "audit", "balance", "bank", "billing", "checking", "compensation", "credit", "currency", "customer", "debit",
        "deduction", "deposit", "discount", "dividend", "due date", "earnings", "employee", "employer", "expense", "fee", "fiscal", "income",
        "interest", "invoice", "irs", "ledger", "loan", "merchant", "mortgage", "overdraft", "payable", "payment", "payroll", "principal",
        "purchase", "receipt", "receivable", "refund", "remittance", "revenue", "routing", "salary", "savings", "statement", "subtotal", "tax",
        "taxable", "total", "transaction", "transfer", "vendor", "w-2", "wages", "wire", "withdrawal", "withholding",
    ],
    "foia": [
        "agency", "appeal", "ask", "classified", "correspondence", "custodian", "declassified", "deliberative", "disclosure", "exemption",
        "fee waiver", "foia", "freedom of information", "glomar", "gov", "government", "information", "investigation", "law enforcement", "letter",
        "memorandum", "narrow", "officer", "open records", "personnel", "privacy", "privilege log", "privileged", "production", "public",
        "public records", "records", "redacted", "redaction", "release", "release in full", "release in part", "request", "requester", "responsive",
        "reviewed", "scope", "search", "sensitive", "sunshine", "transparency", "withheld", "withholding",
    ],
    "generic": [
        "acknowledge", "agenda", "announcement", "appreciate", "approve", "attachment", "author", "business", "client", "company", "confidential",
        "cordially", "courtesy", "department", "draft", "enclosed", "folder", "forward", "greetings", "inquiry", "invitation", "letter", "meeting",
        "memo", "message", "newsletter", "paragraph", "regarding", "regards", "reminder", "reply", "sincerely",
    ],
}

#: Fixed values: (class, rule, pattern on lower-cased text, bonus).
DOCTYPE_BONUSES = [
    ("court", "case_caption_v", r"""(?i)\b[A-Z][A-Za-z'\-]+ v\. [A-Z][A-Za-z'\-]+\b""", 0.15),
    ("court", "docket_number", r"""(?i)\bNo\.\s*\d{2,}-[A-Z]{1,4}-\d{3,}\b""", 0.1),
    ("medical", "icd_shape", r"""(?i)\b[A-TV-Z]\d{2}(?:\.\d{1,4})?\b""", 0.1),
    ("medical", "vitals_bp", r"""(?i)\bBP\s?\d{2,3}/\d{2,3}\b""", 0.08),
    ("medical", "drug_dosage", r"""(?i)\b\d+(?:\.\d+)?\s*(?:mg|mcg|ng|g|ml|iu|units?)\b""", 0.08),
    ("medical", "icd_3char_prefix", r"""(?i)\b[A-TV-Z][0-9]{2}\b""", 0.1),
    ("financial", "currency_amount", r"""\$\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?""", 0.08),
    ("financial", "invoice_label", r"""(?i)\b(?:Invoice|Statement|Receipt)\s*(?:No\.?|#)\s?\w+\b""", 0.1),
    ("foia", "exemption_citation", r"""\b\(b\)\(\d\)\b""", 0.12),
    ("foia", "foia_header", r"""(?i)\bFOIA\s+(?:Request|Response|No\.)\b""", 0.1),
]

#: Cutoff of each category under each preset.
PRESETS = {
    "aggressive": {
        "account": 0.01, "address": 0.01, "creditCard": 0.85, "dea": 0.01, "dob": 0.012, "driversLicense": 0.65, "ein": 0.45, "email": 0.8,
        "itin": 0.5, "licensePlate": 0.5, "mrn": 0.01, "name": 0.01, "npi": 0.602, "passport": 0.65, "phone": 0.55, "routingNumber": 0.01,
        "ssn": 0.502,
    },
    "balanced": {
        "account": 0.6, "address": 0.6, "creditCard": 0.88, "dea": 0.6, "dob": 0.3, "driversLicense": 0.72, "ein": 0.55, "email": 0.83, "itin": 0.65,
        "licensePlate": 0.65, "mrn": 0.6, "name": 0.6, "npi": 0.602, "passport": 0.72, "phone": 0.7, "routingNumber": 0.6, "ssn": 0.6,
    },
    "conservative": {
        "account": 0.7, "address": 0.65, "creditCard": 0.9, "dea": 0.85, "dob": 0.3, "driversLicense": 0.75, "ein": 0.7, "email": 0.85, "itin": 0.78,
        "licensePlate": 0.8, "mrn": 0.87, "name": 0.75, "npi": 0.85, "passport": 0.75, "phone": 0.75, "routingNumber": 0.83, "ssn": 0.9,
    },
}

#: Logistic context term of the two families that use it.
CONTEXT_WEIGHTS = {
    "account": {
        "bias": -8.662341420954795e-16,
        "means": [1.0, 0.0, 0.5729166666666667, 0.0, 9.5, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0],
        "scales": [1e-06, 1e-06, 0.2604166666666667, 1e-06, 0.5, 1e-06, 1e-06, 1e-06, 1e-06, 1e-06, 1e-06, 1e-06, 1e-06],
        "weights": [0.0, 0.0, 2.821843836604714, 0.0, 2.821843836604714, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    },
    "phone": {
        "bias": 1.3765760905735123,
        "means": [0.5768277571251549, 0.061957868649318466, 0.4202878705606254, 0.06019385262551074, 10.0, 0.6592317224287485, 0.38104089219330856, 0.15489467162329615, 0.12329615861214374, 0.3500619578686493, 0.3097893432465923, 0.09293680297397769, 0.12391573729863693],
        "scales": [0.4940622387261733, 0.2410790143537016, 0.3714176001952203, 0.21872309964856382, 1e-06, 0.4739675712244183, 0.48564259560898887, 0.36180424586509125, 0.32877684815636404, 0.4769890811347964, 0.46240664577559576, 0.29034385412292396, 0.32948539777715813],
        "weights": [-1.1993959579892326, -1.0659147577872627, 4.9716804457348465, -0.997677651218164, 0.0, 5.342550777903788, -2.9138246403692425, 1.0019680834065066, 1.1093889920280202, -0.8177691335462705, -0.17348603642693225, 0.41565938358071713, -0.04594291561309031],
    },
}

#: Fixed values: (first, last three-digit ZIP prefix, state).
ZIP_RANGES = [
    (6, 7, "PR"), (8, 8, "VI"), (9, 9, "PR"), (10, 27, "MA"), (28, 29, "RI"), (30, 38, "NH"), (39, 49, "ME"), (50, 54, "VT"), (56, 59, "VT"),
    (60, 69, "CT"), (70, 89, "NJ"), (100, 149, "NY"), (150, 191, "PA"), (193, 196, "PA"), (197, 199, "DE"), (200, 200, "DC"), (201, 201, "VA"),
    (202, 205, "DC"), (206, 212, "MD"), (214, 219, "MD"), (220, 246, "VA"), (247, 268, "WV"), (270, 289, "NC"), (290, 299, "SC"), (300, 310, "GA"),
    (312, 319, "GA"), (320, 331, "FL"), (333, 339, "FL"), (341, 342, "FL"), (344, 344, "FL"), (346, 347, "FL"), (349, 349, "FL"), (350, 352, "AL"),
    (354, 369, "AL"), (370, 374, "TN"), (376, 385, "TN"), (386, 397, "MS"), (398, 398, "GA"), (400, 418, "KY"), (420, 427, "KY"), (430, 458, "OH"),
    (460, 479, "IN"), (480, 499, "MI"), (500, 508, "IA"), (510, 516, "IA"), (520, 528, "IA"), (530, 532, "WI"), (534, 535, "WI"), (537, 549, "WI"),
    (550, 551, "MN"), (553, 554, "MN"), (556, 567, "MN"), (570, 577, "SD"), (580, 588, "ND"), (590, 599, "MT"), (600, 620, "IL"), (622, 629, "IL"),
    (630, 631, "MO"), (633, 641, "MO"), (644, 648, "MO"), (650, 658, "MO"), (660, 662, "KS"), (664, 679, "KS"), (680, 681, "NE"), (683, 693, "NE"),
    (700, 701, "LA"), (703, 708, "LA"), (710, 714, "LA"), (716, 729, "AR"), (730, 731, "OK"), (734, 741, "OK"), (743, 749, "OK"), (750, 770, "TX"),
    (772, 799, "TX"), (800, 816, "CO"), (820, 831, "WY"), (832, 838, "ID"), (840, 841, "UT"), (843, 847, "UT"), (850, 853, "AZ"), (855, 857, "AZ"),
    (859, 860, "AZ"), (863, 865, "AZ"), (870, 871, "NM"), (873, 875, "NM"), (877, 884, "NM"), (890, 891, "NV"), (893, 895, "NV"), (897, 898, "NV"),
    (900, 900, "CA"), (902, 908, "CA"), (910, 928, "CA"), (930, 937, "CA"), (939, 941, "CA"), (943, 961, "CA"), (967, 968, "HI"), (969, 969, "GU"),
    (970, 979, "OR"), (980, 986, "WA"), (988, 994, "WA"), (995, 999, "AK"),
]

#: Five-digit ZIP codes that lie in another state than their prefix.
ZIP_OVERRIDES = {
    "03579": "ME", "06390": "NY", "42223": "TN", "56219": "SD", "57648": "ND", "72338": "TN", "73960": "TX", "79837": "NM", "82063": "CO",
    "82930": "UT", "83120": "ID", "83414": "WY", "86515": "NM", "89421": "OR", "96799": "AS", "96950": "MP", "96951": "MP", "96952": "MP",
    "97635": "CA",
}

#: Unicode white space.
WHITE = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: Categories with their display rank in overlaps.
RANKS = {
    "ssn": 16, "itin": 15, "ein": 14, "creditCard": 13, "dea": 12, "routingNumber": 12, "npi": 11, "mrn": 10, "licensePlate": 8,
    "email": 7, "phone": 6, "name": 5, "dob": 4, "address": 3, "passport": 2, "driversLicense": 1, "account": 1,
}

#: Document classes in canonical order.
DOCTYPES = ["court", "medical", "financial", "foia", "generic"]

#: Classes in which a gated category runs (any other category runs in all).
GATES = {
    "mrn": ["medical"], "npi": ["medical", "foia"], "dea": ["medical"], "account": ["financial", "medical", "court", "generic"],
    "routingNumber": ["financial", "generic"], "licensePlate": ["court", "foia", "generic"],
}

#: Keyword windows: positive and negative keywords, tokens on each side, base, boosted and floor score.
PROFILES = {
    "ssn": (
        ["ssn", "social security", "social security number", "social security no", "ss#", "ssan", "ssno", "ss no", "ss number", "ss num"],
        [
            "case number", "case no", "case #", "docket", "docket no", "docket #", "docket number", "invoice", "invoice #", "invoice no", "invoice number",
            "reference", "reference #", "ref #", "ref no", "reference no", "reference number", "order no", "order #", "order number", "policy no", "policy #",
            "policy number", "file no", "file #", "file number", "claim no", "claim #", "claim number", "account no", "account #", "account number", "receipt",
            "confirmation", "tracking", "tracking #", "tracking no", "permit", "permit no", "permit #", "license no", "license #", "patent", "patent no",
            "serial no", "serial #", "model no", "part no", "item no", "item #", "transaction", "transaction id", "transaction #", "vin", "upc", "sku", "isbn",
        ],
        5, 0.75, 0.95, 0.25,
    ),
    "ein": (
        [
            "ein", "employer identification", "employer id", "federal tax id", "fein", "federal ein", "payer's tin", "payer tin", "recipient tin", "box b",
            "employer's ein", "taxpayer id", "tax id number", "irs form", "w-2", "1099", "schedule c", "employer",
        ],
        [], 6, 0.50, 0.85, 0.25,
    ),
    "itin": (
        ["itin", "individual taxpayer identification", "individual taxpayer id", "tax identification number", "w-7", "irs form w-7", "taxpayer identification", "tin"],
        [], 8, 0.60, 0.85, 0.25,
    ),
    "mrn": (
        ["patient", "medical record", "mrn", "mr#", "chart", "chart number", "dob", "date of birth", "admission", "discharge", "diagnosis", "physician", "hospital"],
        ["invoice", "order", "order no", "order #", "receipt", "transaction", "purchase", "sku", "item", "shipping", "tracking"],
        5, 0.55, 0.92, 0.15,
    ),
    "licensePlate": (
        ["vehicle", "car", "truck", "motorcycle", "dmv", "registration", "vin", "make", "model", "driver", "owner"],
        ["sku", "part number", "order", "product code", "barcode", "serial"],
        5, 0.55, 0.88, 0.20,
    ),
    "npi": (["npi", "provider id", "provider number", "national provider", "national provider identifier", "provider #"], [], 5, 0.65, 0.90, 0.30),
    "dea": (["dea", "dea #", "dea number", "dea registration", "registration", "prescriber", "prescription"], [], 5, 0.55, 0.90, 0.25),
    "account": (["account", "account number", "account #", "acct", "acct #", "acct.", "a/c"], [], 5, 0.0, 0.58, 0.0),
    "routingNumber": (
        [
            "routing", "routing number", "aba", "aba number", "aba routing", "ach", "wire", "wire transfer", "bank routing", "transit number",
            "routing/transit", "routing & transit", "direct deposit",
        ],
        [], 8, 0.50, 0.88, 0.25,
    ),
}

#: What stands within 80 characters of a phone number.
PHONE_WORDS = ["phone", "tel", "fax", "call", "contact", "mobile", "cell", "dial", "sms", "text", "reach", "voicemail", "ext", "extension", "number"]
PHONE_OTHER = [
    "case no", "case #", "case number", "docket no", "docket #", "ref #", "ref no", "reference no", "reference #", "reference number", "claim no", "claim #",
    "invoice no", "invoice #", "order no", "order #", "account no", "account #", "policy no", "policy #", "file no", "file #",
]
BIRTH_WORDS = ["dob", "d.o.b.", "date of birth", "born", "birth date", "birthdate"]

#: Patterns of the rules (category, rule, pattern, the last group is the span).
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
STREETS = "St(?:reet)?|Ave(?:nue)?|Blvd|Boulevard|Dr(?:ive)?|Ln|Lane|Rd|Road|Ct|Court|Pl(?:ace)?|Way|Cir(?:cle)?|Pkwy|Parkway|Hwy|Highway|Ter(?:race)?|Sq(?:uare)?|Loop|Tr(?:ai)?l"
PREFIXES = ["Mr.", "Ms.", "Mrs.", "Dr.", "Judge", "Plaintiff", "Defendant", "Appellant", "Respondent", "Patient", "Witness", "Attorney", "Counsel", "Prof.", "Professor", "Officer", "Agent", "Senator", "Rep.", "Honorable", "Reverend", "Rev."]
PATTERNS = [
    ("ssn", "ssn.regex", r"(?<!\d)(?!000|666|9\d{2})\d{3}([- \x{2011}\x{2012}\x{2013}\x{2014}]?)(?!00)\d{2}\1(?!0000)\d{4}(?!\d)", False),
    ("creditCard", "cc.luhn", r"(?<!\d)\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{1,7}(?!\d)", False),
    # the local part without a repeated alternation, which Java matches by recursion; a run is tried once, from its start
    ("email", "email.regex", r"(?:(?<![a-zA-Z0-9_%+-])|\G)[a-zA-Z0-9_%+-]++(?:\.[a-zA-Z0-9_%+-]++)*+@(?:[a-zA-Z0-9](?:[a-zA-Z0-9.-]*[a-zA-Z0-9])?)\.[a-zA-Z]{2,}", False),
    ("phone", "phone.regex", r"(?<!\d)(?:\+1[\s.-]?)?(?:\(\d{3}\)[\s.-]?\d{3}[\s.-]?\d{4}|\d{3}[\s.-]?\d{3}[\s.-]?\d{4})(?!\d)", False),
    ("ein", "ein.hyphen", r"(?<!\d)\d{2}-\d{7}(?!\d)", False),
    ("ein", "ein.space", r"(?<!\d)\d{2} \d{7}(?!\d)", False),
    ("ein", "ein.run", r"(?<!\d)\d{9}(?!\d)", False),
    ("itin", "itin.yy-bucket", r"(?<!\d)9\d{2}([- \x{2011}\x{2012}\x{2013}\x{2014}]?)\d{2}\1\d{4}(?!\d)", False),
    ("address", "address.street", rf"(?s)\d{{1,5}}\s+[a-zA-Z\s]{{1,30}}\b(?:{STREETS})\b.{{0,100}}?\b[A-Z]{{2}}\s+\d{{5}}(?:-\d{{4}})?", False),
    ("address", "address.po-box", r"(?i)\b(?:P\.?O\.?\s*Box|Post\s+Office\s+Box)\s+\d{1,6}\b", False),
    ("address", "address.rural", r"(?i)\b(?:R(?:ural\s+)?R(?:oute)?|RR|HC|Star\s+Route)\s+\d{1,4}\s+Box\s+\d{1,6}[A-Z]?\b", False),
    ("address", "address.military", r"(?i)\b(?:APO|FPO|DPO)\s+(?:AA|AE|AP)\s+\d{5}(?:-\d{4})?\b", False),
    ("dob", "dob.numeric", r"(?<!\d)\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}(?!\d)", False),
    ("dob", "dob.textual", rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b", False),
    ("dob", "dob.labelled", r"(?i)(?:D\.?O\.?B\.?|Date\s+of\s+Birth|Born|Birth\s*Date|Birthdate)\s*:?\s*(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|[a-zA-Z0-9_]+\s+\d{1,2},?\s+\d{4})", False),
    ("driversLicense", "dl.regex", r"(?i)(?:Driver(?:'?s)?\s+Lic(?:ense)?|DL|D\.?L\.?)\s*[:#]?\s*([A-Z]\d{4,14}|\d{6,12})", True),
    ("passport", "passport.regex", r"(?i)(?:Passport|PP|Passport\s+No|Passport\s+Number)\s*[#:]?\s*([A-Z]{1,2}\d{6,9})", True),
    ("mrn", "mrn.labeled", r"(?i)\bMR[N]?[:#\s]+[A-Z0-9]{5,12}\b", False),
    ("mrn", "mrn.patientID", r"(?i)\bPatient\s+ID[:#\s]+[A-Z0-9]{5,12}\b", False),
    ("mrn", "mrn.institution", r"\b[A-Z]{2,5}-\d{6,10}\b", False),
    ("npi", "npi.80840", r"(?<!\d)[12]\d{9}(?!\d)", False),
    ("dea", "dea.letter-check", r"(?<![A-Z])[A-Z]{2}\d{7}(?!\d)", False),
    ("account", "account.regex", r"(?<![A-Za-z0-9])[A-Z]{0,3}\d{6,15}(?![A-Za-z0-9])", False),
    ("routingNumber", "routingNumber.aba-checksum", r"(?<!\d)\d{9}(?!\d)", False),
    ("licensePlate", "licensePlate.labeled", r"(?i)\b(?:license\s+plate|plate\s+(?:no|number|#)\.?|tag\s+(?:no|number|#)\.?|lp\s*#|reg(?:istration)?\s*#|veh(?:icle)?\s+plate)[:#\s]+[A-Z0-9]{2,3}[-\s]?[A-Z0-9]{2,5}\b", False),
    ("name", "name.prefix", "(?:" + "|".join(p.replace(".", r"\.") for p in PREFIXES) + r")[\s:,;.\-—–]*(\p{Lu}[^\s]*(?: \p{Lu}[^\s]*){0,2})", True),
]

#: Passport numbers by issuer.
PASSPORTS = {
    "CA": r"^[A-Z]{2}[0-9]{6}$|^[A-Z][0-9]{6}[A-Z]{2}$", "CN": r"^(?:G[0-9]{8}|E[0-9]{8}|E[A-HJ-NP-Z][0-9]{7})$", "DO": r"^[A-Z]{3}[0-9]{6}$",
    "GB": r"^[0-9]{9}$", "IN": r"^[A-PR-WY][1-9][0-9]{5}[1-9]$|^[A-Z][0-9]{7}$", "KR": r"^[MSROD][0-9]{8}$|^[MSROD][0-9]{3}[A-Z][0-9]{4}$",
    "MX": r"^[A-Z][0-9]{8}$", "PH": r"^[A-Z]{2}[0-9]{7}$|^[A-Z][0-9]{7}[A-Z]$", "SV": r"^[A-Z0-9]{9}$", "US": r"^[0-9]{9}$|^[A-Z][0-9]{8}$", "VN": r"^[A-Z][0-9]{8}$",
}

#: Two-digit prefixes never issued for an EIN; first letters of registrants; saved patterns.
EIN_NEVER = ["00", "07", "08", "09", "17", "18", "19", "28", "29", "49", "69", "70", "78", "79", "89", "96", "97"]
DEA_LETTERS = "ABCDEFGHJKLMPRSTUX"
SAVED = {
    "caseNumber": r"\b\d{2,4}[-\s]?[A-Z]{1,4}[-\s]?\d{3,6}\b", "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "ipv4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "uuid": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    "iso8601": r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\b|\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{2}:?\d{2}\b|\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\b|\b\d{4}-\d{2}-\d{2}\b",
    "ssn": r"\b(?!000|666|9\d{2})\d{3}[-\s]?(?!00)\d{2}[-\s]?(?!0000)\d{4}\b", "ein": r"\b(?!00|07|08|09)\d{2}[-\s]?\d{7}\b",
    "itin": r"\b9\d{2}[-\s]?(?:5\d|6[0-5]|7\d|8[0-8]|9[0-2]|9[4-9])[-\s]?\d{4}\b", "abaRouting": r"(?<!\d)(?:0[1-9]|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)\d{7}(?!\d)",
    "accountNumber": r"\b[A-Z]{0,3}(?<![A-Z]{4})\d{6,17}\b",
}

#: Words kept in capitals; characters that look alike to a scanner; typographic marks.
ACRONYMS = [
    "FBI", "CIA", "SSN", "EIN", "DOJ", "DOD", "IRS", "SEC", "FTC", "LLC", "INC", "LLP", "DBA", "AKA", "DOB", "SSA", "ICE", "DEA",
    "ATF", "TSA", "FAA", "EPA", "FDA", "OSHA", "HIPAA", "FOIA", "USA", "NYC", "PDF", "OCR", "PII",
]
TO_DIGITS, TO_LETTERS = ("OoIlBSZG", "00118526"), ("0158", "OISB")
MARKS = ("“”‘’–—‒‑­", "\"\"''-----")
SEPARATORS = "- ./,"

#: Catalogue names of rules.
CATALOGUE = {
    "ssn.state-machine": "pii.ssn.state_machine.v1", "ssn.regex": "pii.ssn.state_machine.v1", "cc.luhn": "pii.cc.luhn.v1", "dea.letter-check": "pii.dea.checksum.v1", "npi.80840": "pii.npi.luhn.v1",
    "name.nltagger": "pii.name.nltagger.v1", "licensePlate.labeled": "pii.lp.v1", "mrn.labeled": "pii.mrn.labeled.v1", "mrn.patientID": "pii.mrn.patient_id.v1",
    "mrn.institution": "pii.mrn.institution.v1", "mrn.regex": "pii.mrn.labeled.v1", "account.regex": "pii.account.v1", "routingNumber.aba-checksum": "pii.routing_number.v1",
    "barcode.vision": "pii.barcode.vision.v1", "signature.heuristic": "pii.signature.heuristic.v1", "phone.regex": "pii.phone.v1", "email.regex": "pii.email.v1", "ein.regex": "pii.ein.v1",
    "itin.regex": "pii.itin.v1", "itin.yy-bucket": "pii.itin.v1", "dob.regex": "pii.dob.v1", "passport.regex": "pii.passport.v1", "dl.regex": "pii.dl.v1", "address.regex": "pii.address.v1",
}

#: Names and codes of states.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL",
    "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME",
    "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT",
    "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}
MORE_STATES = ["PR", "VI"]
STREET_LINE = r"(?i)\b\d{1,5}\s+[A-Za-z][A-Za-z0-9\s.,#-]{1,50}\b(?:St(?:reet)?|Ave(?:nue)?|Blvd|Boulevard|Dr(?:ive)?|Ln|Lane|Rd|Road|Ct|Court|Pl(?:ace)?|Way|Cir(?:cle)?|Pkwy|Parkway|Hwy|Highway|Ter(?:race)?|Sq(?:uare)?|Loop)\b"
ZIP_LINE = r"\b(\d{5})(?:-\d{4})?\b"
