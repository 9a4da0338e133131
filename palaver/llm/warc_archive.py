"""Operator 8: a content-addressed WARC archive.

Writing: each row becomes a WARC record. Its payload is stored once for all records that share it,
in ``payloads`` under its SHA-256; the exact bytes of each record's header are kept in ``headers``
with that key. Reading joins the two, checks the stored bytes against SHA-256, SHA-1 and the header's
lengths, and gives the records back byte for byte. Of the records with one payload (of ``least`` bytes or more),
that with the largest id (null: smallest; of equal ids, any one) is the ``response``, the others are
``revisit`` records that refer to it. Records with smaller payloads are all ``response``.

A null payload is an empty one. Null ids and urls stay null. Repeated rows give a record each; very long
payloads are stored whole; other columns take no part; an empty table gives an empty archive. Both
tables are Parquet below ``path``; rows carry a record number so that equal rows stay apart. A url with
a line end stands percent-encoded in its own header and exactly, as base64, in another.
Payloads meet by digest, and copies are merged on each machine before the shuffle, so that one page
that makes up a third of the crawl crosses the network once for each task, not for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, read, shared_dir

CRLF = "\r\n"


def base32_of_hex(hexed: Column) -> Column:
    """Upper-case base32 (RFC 4648) of 40 hexadecimal digits: five of them make four characters."""
    digits = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_uri(record: Column) -> Column:
    """``<urn:uuid:...>`` of a record number, of the version for values of one's own making."""
    h = F.md5(record.cast("string"))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: Column | None = None) -> None:
    """Write ``headers`` and ``payloads`` below ``path``, a folder that all executors share. ``date``: a
    timestamp, when the page was fetched; null or not given: the time of writing."""
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), _utc(F.coalesce(date, F.current_timestamp()) if date is not None else F.current_timestamp()).alias("date"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumns({"sha256": F.unhex(F.sha2("payload", 256)), "sha1": F.sha1("payload"), "bytes": F.length("payload").cast("long")})
    # The payload is read again for the store; what decides the records is small and made once.
    facts = checkpointed(keyed.select(F.monotonically_increasing_id().alias("record"), "id", "url", "date", "sha256", "sha1", "bytes"))
    leads = facts.where(F.col("bytes") >= least).groupBy("sha256").agg(F.max(F.struct(F.coalesce("id", F.lit(-(2**63))), "record", "id", "url", "date")).alias("lead"))
    leads = checkpointed(leads)  # so that the join can split a payload of very many records
    said = facts.join(leads, "sha256", "left").withColumn("revisit", F.coalesce(F.col("lead.record") != F.col("record"), F.lit(False)))
    digest = base32_of_hex(F.col("sha1"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    maybe = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", record_uri(F.col("record"))),
        line("WARC-Date", F.col("date")),
        maybe("WARC-Target-URI", one_line(F.col("url"))),
        maybe("X-Target-URI-Base64", F.when(F.col("url").rlike(r"[\r\n]"), F.regexp_replace(F.base64(F.encode("url", "UTF-8")), r"\s", ""))),
        maybe("X-Page-ID", F.col("id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_uri(F.col("lead.record"))), maybe("WARC-Refers-To-Target-URI", one_line(F.col("lead.url"))), line("WARC-Refers-To-Date", F.col("lead.date")), maybe("X-Refers-To-Page-ID", F.col("lead.id").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit(CRLF),
        http,
    )
    said.select("record", F.encode(header, "UTF-8").alias("header"), "sha256").write.parquet(f"{path}/headers")
    keyed.groupBy("sha256").agg(F.any_value("payload").alias("payload")).write.parquet(f"{path}/payloads")


def _utc(at: Column) -> Column:
    """A timestamp as WARC writes it, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def one_line(url: Column) -> Column:
    """A url as a header can hold it."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records: record, header, payload (the full one, for revisits too), verified, and the
    fields id, url, record_type, payload_digest, payload_bytes and refers_to. Verified: the stored bytes
    have the digests of store and header, and header and payload make up the length that it states."""
    headers, store = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    checked = store.select("sha256", "payload", (F.unhex(F.sha2("payload", 256)) == F.col("sha256")).alias("intact"), base32_of_hex(F.sha1("payload")).alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes"))
    text = F.decode("header", "UTF-8")
    field = lambda name, like: F.nullif(F.regexp_extract(text, rf"\r\n{name}: ({like})\r\n", 1), F.lit(""))
    http_bytes = F.length(text) - F.instr(text, CRLF * 2) - 3  # ASCII
    revisit = field("WARC-Type", r"\w+") == "revisit"
    whole = field("Content-Length", r"\d+").cast("long") == http_bytes + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    said = F.when(text.contains(f"{CRLF}WARC-Target-URI: "), F.regexp_extract(text, r"\r\nWARC-Target-URI: ([^\r\n]*)\r\n", 1))
    url = F.coalesce(F.decode(F.unbase64(field("X-Target-URI-Base64", r"[\w+/=]+")), "UTF-8"), said)
    return headers.join(checked, "sha256", "left").select(
        "record", "header", "payload",
        field("X-Page-ID", r"-?\d+").cast("long").alias("id"),
        url.alias("url"),
        field("WARC-Type", r"\w+").alias("record_type"),
        "payload_digest", "payload_bytes",
        field("X-Refers-To-Page-ID", r"-?\d+").cast("long").alias("refers_to"),
        F.coalesce(F.col("intact") & whole & (field("WARC-Payload-Digest", r"[^\r\n]*") == F.concat(F.lit("sha1:"), "payload_digest")), F.lit(False)).alias("verified"),
    )


def record_bytes(record_type: Column, header: Column, payload: Column) -> Column:
    """The bytes of a record as they stand in a .warc file."""
    body = F.when(record_type == "revisit", F.lit(b"")).otherwise(payload)
    return F.concat(header, body, F.lit(b"\r\n\r\n"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """record and bytes: every record as it stands in a .warc file, rebuilt by the join; fails on damage."""
    found = read_archive(spark, path)
    whole = record_bytes(F.col("record_type"), F.col("header"), F.col("payload"))
    return found.select("record", F.when(F.col("verified"), whole).otherwise(_damage()).alias("bytes"))


def _damage() -> Column:
    return F.raise_error(F.lit("a payload does not match its digest"))


def op8_warc_archive(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archive(read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archive(spark, path).select(
        F.col("id").alias("page_id"), "payload_bytes",
        F.when(F.col("verified"), F.col("payload_digest")).otherwise(_damage()).alias("payload_digest"),
        "record_type", "refers_to",
        F.when(F.col("verified"), True).otherwise(_damage()).alias("verified"),
    )


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT page_id, h, strlen(html) AS payload_bytes, unhex(h)::BIT::VARCHAR AS bits,
         max(page_id) OVER (PARTITION BY h) AS lead FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
      + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
      + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> lead THEN lead END AS refers_to, true AS verified
FROM b
"""
