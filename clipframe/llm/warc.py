"""Content-addressed WARC archive: payload bytes once by verified strong digest, exact record headers apart from them.

An archive is two Parquet tables in one folder:

* ``payloads`` (content string, payload binary): each distinct payload once, named by its SHA-256;
* ``headers`` (record_no, header binary, content): the exact WARC/1.1 header block of each record, without payload.

Null html is an empty payload, a null url an empty one; control characters of a url are escaped.  Payloads may be of any
length; an empty table gives an empty archive.  Payloads of at least ``least_bytes`` that are equal have
one response, that with the largest page id (null ids are the smallest; equal ids: the last read); the others
are revisits.  Rows that are wholly equal are records of their own.  Other columns aren't archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CRLF = "\r\n"


def _digests(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    p = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    return p.withColumns({"record_no": F.monotonically_increasing_id(), "payload_bytes": F.octet_length("payload").cast("bigint"), "sha1": F.sha1("payload"), "content": F.sha2("payload", 256)})


def one_line(url: Column) -> Column:
    """An address with its control characters as %00 to %1F, so that it ends no header line."""
    escaped = url
    for i in range(32):
        escaped = F.replace(escaped, F.lit(chr(i)), F.lit(f"%{i:02X}"))
    return F.when(url.rlike(r"[\x00-\x1f]"), escaped).otherwise(url)


def _header(date: str) -> Column:
    """Header block of a record: WARC/1.1 fields, each line ended by CRLF, then an empty line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    record_id = lambda n: F.concat(F.lit("<urn:clipframe:"), n.cast("string"), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    return F.encode(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"),
            line("WARC-Type", F.col("record_type")),
            line("WARC-Record-ID", record_id(F.col("record_no"))),
            line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", one_line(F.col("url"))),
            F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
            F.when(revisit & F.col("refers_to").isNotNull(), line("X-Refers-To-Page-ID", F.col("refers_to").cast("string"))).otherwise(""),
            F.when(revisit, line("WARC-Refers-To", record_id(F.col("best_no")))).otherwise(line("Content-Type", F.lit("text/html; charset=utf-8"))),
            line("X-Payload-Length", F.col("payload_bytes").cast("string")),
            line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
            F.lit(CRLF),
        ),
        "UTF-8",
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write an archive of ``pages`` to ``path`` and return it.

    Payloads shuffle once, already reduced to one for each digest and task; all other steps move digests.
    Payloads that share a SHA-256 must agree in length, SHA-1 and a third hash, or the write fails.
    """
    p = _digests(pages, id_col, url_col, html_col)
    records = common.stored(p.drop("payload"), "records")
    same = F.struct(F.col("payload_bytes"), F.col("sha1"), F.xxhash64("payload"))
    store = p.select("content", same.alias("same"), "payload").groupBy("content").agg(F.min("same").alias("a"), F.max("same").alias("b"), F.first("payload").alias("payload"))
    verified = F.when(F.col("a") == F.col("b"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads have one SHA-256")).cast("binary"))
    store.select("content", verified.alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    large = records.where(F.col("payload_bytes") >= least_bytes)
    best = large.groupBy("content").agg(F.max(F.struct("page_id", "record_no")).alias("best"), F.count("*").alias("n"))
    best = common.stored(best.where("n > 1").select("content", F.col("best.page_id").alias("best_id"), F.col("best.record_no").alias("best_no")), "best")
    r = records.join(best, "content", "left")
    r = r.withColumn("record_type", F.when(F.col("best_no").isNotNull() & (F.col("best_no") != F.col("record_no")), "revisit").otherwise("response"))
    r = r.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("best_id")))
    r.select("record_no", _header(date).alias("header"), "content").write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def _field(name: str, pattern: str = r"([^\r]*)") -> Column:
    """Value of a header field; null where it is missing."""
    value = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: {pattern}\r\n", 1)
    return F.when(F.decode("header", "UTF-8").rlike(rf"\r\n{name}: "), value)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The original records: header joined with its payload.

    Columns: record_no, record_type, page_id, url, refers_to, header, payload, and from the stored bytes
    payload_bytes and payload_digest (hex SHA-1).  A payload that isn't what its name says fails the read.
    """
    payloads = spark.read.schema("content string, payload binary").parquet(f"{path}/payloads")
    right = F.when(F.sha2("payload", 256) == F.col("content"), F.sha1("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("content"))))
    payloads = payloads.select("content", "payload", F.octet_length("payload").cast("bigint").alias("payload_bytes"), right.alias("payload_digest"))
    headers = spark.read.schema("record_no long, header binary, content string").parquet(f"{path}/headers")
    headers = headers.select(
        "record_no",
        "content",
        "header",
        _field("WARC-Type").alias("record_type"),
        _field("X-Page-ID").cast("bigint").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("X-Refers-To-Page-ID").cast("bigint").alias("refers_to"),
    )
    return headers.join(payloads, "content").select("record_no", "record_type", "page_id", "url", "refers_to", "header", "payload", "payload_bytes", "payload_digest")


def warc_bytes(records: DataFrame) -> DataFrame:
    """Records as they stand in a WARC file: header, payload (none in a revisit), two line ends."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return records.select("record_no", F.concat("header", body, F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record"))


def write_files(records: DataFrame, path: str, compression: str = "gzip") -> str:
    """WARC files of these records: each file is a run of whole records, one after another, as readers of WARC take them.

    The text writer ends every record with the two line ends that the format asks for.
    """
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    records.select(F.concat("header", body).cast("string").alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)
    return path
