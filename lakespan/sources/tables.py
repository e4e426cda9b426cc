"""Tables, files and the invented fixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 50_000_000

#: Invented texts with an identifier of each category, near misses and context; ids are negative.
FIXTURE = [
    "Applicant SSN: 212-45-6789 on file. Not valid: 000-12-3456, 666-12-3456, 912-34-5678, 078-05-1120.",
    "docket no 219-45-6788 was entered; social security no 301-22-4455 also appears.",
    "Visa 4111 1111 1111 1111 and Amex 3782 822463 10005, bad 4111 1111 1111 1112, other 5555-5555-5555-4444.",
    "Mail jane.doe@example.com or ops+x@mail.example.org, not .a@b or a..b@example.com.",
    "Call (415) 555-2671 or +1 415.555.2672 by phone; case no 415-555-2673 stays.",
    "reference # 212-555-0188 in the ledger of March",
    "Employer EIN 12-3456789 and 07-1234567, also employer 12 3456780 and 123456781 in box b.",
    "plain number 987654321 here and 12 7654321 there",
    "ITIN 912-70-1234, taxpayer id 912-33-1234, bare 999-88-1234",
    "12 Main Street, Springfield, IL 62704 and P.O. Box 443 or RR 2 Box 17B or APO AE 09012-1234",
    "Patient DOB 02/29/1984 aged 40; also 02/30/1984 and 13/01/1999. Seen March 4, 2021.",
    "Date of Birth: 7/4/1976. Invoice total amount due, account balance payment bank statement.",
    "Driver's License: D1234567 and DL# 12345678 were shown",
    "Passport No: A12345678 and passport X1 and Passport AB123456",
    "patient hospital chart diagnosis physician admission MRN: 12345678 discharge ABC-1234567",
    "Patient ID: A1B2C3 order receipt shipping item; hospital nurse surgery therapy",
    "provider NPI 1234567893 and 1234567890 in clinic patient diagnosis hospital treatment",
    "DEA AB1234563 prescriber, bad AB1234564, patient hospital nurse pharmacy prescription",
    "account number 123456789012 of the bank, XYZ998877 elsewhere, acct # AB12345678",
    "wire transfer routing 021000021 bank account deposit; not 021000022 nor 991000021",
    "license plate: ABC-1234 of the vehicle; tag no 7XYZ 123 seen",
    "Mr. John Smith met Dr. Ada Lovelace King and Judge Roy Bean; Attorney: Mary Jones",
    "Smith v. Jones court plaintiff defendant motion judge No. 23-CV-1234 docket",
    "FOIA Request agency records exemption redacted release responsive public records",
    "Invoice #A77 total $1,250.00 tax payment due from customer, employee salary wages",
    "dear client, regards and sincerely: agenda meeting memo reminder attachment",
    "server 10.20.30.40 at 2024-05-06T07:08:09Z id 123e4567-e89b-12d3-a456-426614174000",
    "case 23-CV-12345 with IBAN GB29NWBK60161331926819 was closed",
    "“Smart” quotes — dashes‑and café naïve résumé",
    "order 1OO-23-4567 and B0X O1 lI5 of the l1ne 2O24",
    "repeat repeat repeat Repeat REPEAT repeated prerepeat",
    "FBI AND CIA MET JOHN IN NYC TODAY",
    "=cmd() and -1+2 @here",
    "",
    "short",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "מסמך בעברית עם מספר 212-45-6789 בתוכו",
    "123 123-45-6789 and 5 212-45-6781",
    "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" tel 2125550147 reach us",
    "lp # 8ABC123 barcode serial; veh plate QRS 4567 car owner driver",
    "Mr. John Smith again with SSN 212-45-6789, mail jane.doe@example.com",
    "Ship to\n450 Oak Avenue\nSuite 9\nBoston, Massachusetts 02110",
    "77 Pine Rd\nAustin TX\n10001\nnothing\nmore\n\n90210-1234",
    "Internal Revenue Service notice\nSSN 301-22-4455 for Mr. Roy Bean, provider npi 1234567893",
    "First National Bank statement, national bank of nowhere, ssn 212-45-6788",
]

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession) -> DataFrame:
    """doc_id (from -1 down), text."""
    rows = ", ".join(f"({-1 - i}L, '{_quoted(t)}')" for i, t in enumerate(FIXTURE))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(doc_id, text)")


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text of documents and the fixture."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(fixture(spark))


def read(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A known table from files of any format, always with its own schema."""
    return spark.read.schema(SCHEMAS[name]).format(fmt).load(path)


def file_kind(head: Column) -> Column:
    """The kind of a file by its first twelve bytes."""
    h = F.hex(F.substring(head, 1, 12))
    brand = F.substring(h, 17, 8)
    brands = ["heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs", "mif1", "msf1"]
    return (
        F.when(h.startswith("25504446"), "pdf")
        .when(h.startswith("FFD8FF"), "jpeg")
        .when(h.startswith("89504E470D0A1A0A"), "png")
        .when(h.startswith("52494646") & (brand == "57454250"), "webp")
        .when((F.substring(h, 9, 8) == "66747970") & brand.isin(*[b.encode().hex().upper() for b in brands]), "heif")
        .otherwise("unknown")
    )


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, kind, accepted: files of a folder, by their content, up to 50 MB."""
    rows = spark.read.format("binaryFile").load(path)
    kind = file_kind(F.col("content"))
    return rows.select("path", "length", kind.alias("kind")).withColumn("accepted", (F.col("kind") != "unknown") & (F.col("length") <= MAX_BYTES))


def checked(spark: SparkSession, path: str, sha256: str) -> bool:
    """Whether a file's digest is the expected one; what depends on it falls back to defaults if not."""
    row = spark.read.format("binaryFile").load(path).select((F.sha2("content", 256) == sha256).alias("ok")).first()
    return bool(row and row.ok)


def sized(pages: DataFrame, most: float = 5000.0) -> DataFrame:
    """Adds accepted: pages whose width and height are above 0 and at most 5000 units; unknown sizes are not accepted."""
    side = lambda c: F.col(c).between(0, most) & (F.col(c) > 0)
    return pages.withColumn("accepted", F.coalesce(side("width") & side("height"), F.lit(False)))


def gated(spark: SparkSession, path: str, sha256: str, schema: str) -> tuple[DataFrame, bool]:
    """(a JSON table, whether it is degraded): the table is empty if the file's digest is not the expected one."""
    if checked(spark, path, sha256):
        return spark.read.schema(schema).option("multiLine", True).json(path), False
    return spark.createDataFrame([], schema), True


def versioned(row: dict, name: str, low: int, high: int) -> dict:
    """The row, if its version is supported."""
    if not low <= int(row.get("version", -1)) <= high:
        raise ValueError(f"{name}: version {row.get('version')} is not from {low} to {high}")
    return row
