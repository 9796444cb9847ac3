"""Content-addressed WARC archive: payload bytes once, record headers apart, records rebuilt by joins.

An archive is a folder of two tables:

* ``payloads`` (sha256, payload): each distinct payload once, named by its SHA-256;
* ``headers`` (page_id, sha256, header): the exact header block of every record, byte for byte, up to and with
  its empty line.

A record is its header, followed for a ``response`` by its payload, then CR LF CR LF. Of pages with equal
payloads the one with the largest page_id is the response and the others are revisits of it. Pages that carry
that same largest page_id (repeated rows) are responses all, and still share one stored payload. A page without
page_id is a revisit unless no page of its group has one; then all of the group are responses. Null html is an
empty payload; a null url leaves the target header out, and control characters in a url are percent-escaped.

Verification: while writing, all members of a digest must agree in length and in SHA-1, else the write fails;
while reading, every payload is digested again and must match its name.

Payload bytes move through one shuffle at most, in the join that selects the rows to store. A payload that a
third of all pages share moves no rows to one task: what is grouped is (digest, page_id), combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base-32 digits in natural order (fixed values, RFC 4648).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: five hexadecimal digits make four digits of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _header(page: Column, url: Column, kind: Column, refers: Column, digest: Column, size: Column, date: str) -> Column:
    identity = lambda x: F.concat(F.lit("<urn:x-page:"), x.cast("string"), F.lit(">"))
    clean = url
    for char, code in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20")):
        clean = F.replace(clean, F.lit(char), F.lit(code))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        optional("WARC-Record-ID", identity(page)),
        optional("WARC-Target-URI", clean),
        F.lit(f"WARC-Date: {date}{CRLF}"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        optional("WARC-Refers-To", F.when(kind == "revisit", identity(refers))),
        F.when(kind == "revisit", F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}")).otherwise(""),
        F.lit(f"Content-Type: text/html; charset=utf-8{CRLF}"),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(size.cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the two tables of the archive of ``pages`` under ``folder``."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    facts = rows.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    groups = facts.groupBy("sha256").agg(
        F.max("page_id").alias("keeper"),
        F.min("sha1").alias("a"), F.max("sha1").alias("b"), F.min("bytes").alias("m"), F.max("bytes").alias("n"),
    )
    alike = (F.col("a") == F.col("b")) & (F.col("m") == F.col("n"))
    groups = groups.select("sha256", "keeper", F.when(~alike, F.raise_error(F.lit("payloads of one digest differ"))).cast("boolean").alias("differs")).where("differs IS NULL").drop("differs")
    kind = F.when(F.col("page_id").eqNullSafe(F.col("keeper")), "response").otherwise("revisit")
    header = _header(F.col("page_id"), F.col("url"), kind, F.col("keeper"), F.col("sha1"), F.col("bytes"), date)
    facts.join(groups, "sha256").select("page_id", "sha256", header.alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")

    responses = spark.read.parquet(f"{folder}/headers").where(header_field("WARC-Type") == "response").select("page_id", "sha256")
    named = rows.select("page_id", F.sha2("payload", 256).alias("sha256"), "payload").alias("p")
    chosen = named.join(
        responses.distinct().hint("shuffle_hash").alias("r"),
        F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.sha256") == F.col("r.sha256")),
    ).select("p.sha256", "payload")
    if responses.groupBy("sha256").count().where("count > 1").limit(1).count():  # repeated rows of one page
        chosen = chosen.dropDuplicates(["sha256"])
    chosen.write.option("compression", "zstd").parquet(f"{folder}/payloads")


def header_field(name: str, header: str = "header") -> Column:
    """The value of a named field of a header block; null where the field is absent."""
    return F.nullif(F.regexp_extract(F.col(header), rf"\r\n{name}: ([^\r]*)", 1), F.lit(""))


def read_archive(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of an archive; reading a payload whose bytes don't match its name fails."""
    payloads = spark.read.parquet(f"{folder}/payloads")
    good = F.sha2("payload", 256) == F.col("sha256")
    payloads = payloads.select("sha256", F.when(good, F.col("payload")).otherwise(F.raise_error(F.lit("a payload doesn't match its digest")).cast("binary")).alias("payload"))
    return spark.read.parquet(f"{folder}/headers"), payloads


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record): the bytes of every WARC record; a revisit has no block."""
    headers, payloads = read_archive(spark, folder)
    is_response = header_field("WARC-Type") == "response"
    with_block = headers.where(is_response).join(payloads, "sha256")
    without = headers.where(~is_response).withColumn("payload", F.lit(b""))
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    return with_block.unionByName(without).select("page_id", F.concat(F.encode("header", "UTF-8"), "payload", end).alias("record"))


def pages_back(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, html) as archived: revisits get the payload they refer to; null html comes back empty."""
    headers, payloads = read_archive(spark, folder)
    return headers.join(payloads, "sha256").select("page_id", header_field("WARC-Target-URI").alias("url"), F.decode("payload", "UTF-8").alias("html"))


def export_warc(spark: SparkSession, folder: str, target: str) -> None:
    """Write the records as plain .warc text files under ``target`` (one per partition)."""
    text = records(spark, folder).select(F.decode("record", "UTF-8").alias("record"))
    text.select(F.expr("left(record, length(record) - 4)")).write.option("lineSep", CRLF * 2).text(target)


def archived_pages(spark: SparkSession, folder: str) -> DataFrame:
    """What the archive says of each page; sizes and digests are taken anew from the stored bytes."""
    headers, payloads = read_archive(spark, folder)
    facts = payloads.select("sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    refers = F.regexp_extract(header_field("WARC-Refers-To"), r"page:(-?\d+)", 1).cast("long")
    read = headers.select("page_id", "sha256", header_field("WARC-Type").alias("record_type"), refers.alias("refers_to"), header_field("WARC-Payload-Digest").alias("declared"))
    checked = F.when(F.col("declared") == F.concat(F.lit("sha1:"), "payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header declares another digest")).cast("string"))
    return read.join(facts, "sha256").select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
