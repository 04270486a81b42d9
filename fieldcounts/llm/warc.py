"""WARC records as a content-addressed archive.

An archive is two tables in one folder.  ``payloads`` holds every different
payload once, under its SHA-256; ``records`` holds the exact header bytes of
every record (the WARC header and the HTTP header of its block) and the digest
of its payload.  A record is rebuilt by joining the two, and the stored bytes
are hashed again on reading, so a damaged payload is found.

Of records whose payloads are equal and have at least ``min_bytes`` bytes, the
one with the smallest id is a ``response`` and the others are ``revisit``
records that name it; smaller payloads always give responses.

Defined results: a NULL payload is an empty one; a NULL id is written as an
empty id and read back as NULL (it is a revisit only if another row of the
same payload has an id); a NULL url gives a record without a target; repeated
rows are repeated records, and rows that share the smallest id are all
responses; extra columns are ignored; an empty table gives empty archives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import table

HTTP_HEADER = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, *value):
    return F.concat(F.lit(f"{name}: "), *[F.lit(v) if isinstance(v, str) else v for v in value], F.lit("\r\n"))


def _id_text(column):
    return F.coalesce(column.cast("string"), F.lit(""))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` under ``path`` (see the module's docstring).

    The digests alone are grouped (a payload that a third of all rows share is
    one partial row per task).  Payload bytes cross the network once, dealt by
    id, which no hot payload can skew.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("rec_id"), F.col(url_col).cast("string").alias("rec_url"),
        F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"digest": F.unhex(F.sha2("payload", 256)), "payload_bytes": F.octet_length("payload")})
    first = rows.groupBy("digest").agg(F.min("rec_id").alias("first_id"))
    keep = first.select(F.coalesce("first_id", F.lit(0)).alias("key"), "digest")
    (rows.select(F.coalesce("rec_id", F.lit(0)).alias("key"), "digest", "payload")
     .join(keep, ["key", "digest"], "left_semi").select("digest", "payload")
     .write.option("compression", "zstd").parquet(f"{path}/payloads"))

    revisit = ((F.col("payload_bytes") >= min_bytes) & F.col("first_id").isNotNull()
               & ~F.col("rec_id").eqNullSafe(F.col("first_id")))
    size = F.lit(len(HTTP_HEADER)) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", "<urn:record:", _id_text(F.col("rec_id")), ">"),
        F.coalesce(_line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("rec_url", "\r", "%0D"), "\n", "%0A")),
                   F.lit("")),
        _line("WARC-Date", date),
        _line("WARC-Payload-Digest", "sha256:", F.lower(F.hex("digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", PROFILE),
                                 _line("WARC-Refers-To", "<urn:record:", _id_text(F.col("first_id")), ">")))
        .otherwise(""),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", size.cast("string")),
        F.lit("\r\n" + HTTP_HEADER))
    (rows.select("rec_id", "rec_url", "digest", "payload_bytes").join(first, "digest")
     .select(F.encode(header, "UTF-8").alias("header"), "digest")
     .write.parquet(f"{path}/records"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records rebuilt from an archive: their parsed headers, verified payload and exact ``record`` bytes.

    ``payload_digest`` and ``payload_bytes`` come from the stored bytes, not
    from the headers; ``verified`` tells whether they agree with the digest the
    record asks for.  Only asked-for columns are read and shuffled: without
    ``record`` and ``payload`` the bytes stay where they are read.
    """
    # one row per digest, also if rows with one id were repeated; the join below uses the same exchange
    stored = spark.read.parquet(f"{path}/payloads").groupBy(F.col("digest").alias("stored_digest")).agg(
        F.any_value("payload").alias("payload"))
    stored = stored.select("stored_digest", "payload", F.sha2("payload", 256).alias("payload_digest"),
                           F.octet_length("payload").cast("long").alias("payload_bytes"))
    records = spark.read.parquet(f"{path}/records").withColumn("head", F.decode("header", "UTF-8"))

    def field(name):
        return F.regexp_extract("head", rf"(?m)^{name}\r?$", 1)

    rid, refers = field("WARC-Record-ID: <urn:record:(-?\\d*)>"), field("WARC-Refers-To: <urn:record:(-?\\d*)>")
    kind = field("WARC-Type: (\\w+)")
    return (records.join(stored, records.digest == stored.stored_digest, "left")
            .select(F.nullif(rid, F.lit("")).cast("long").alias("record_id"), "payload_bytes", "payload_digest",
                    kind.alias("record_type"), F.nullif(refers, F.lit("")).cast("long").alias("refers_to"),
                    F.coalesce(F.unhex("payload_digest") == F.col("digest"), F.lit(False)).alias("verified"),
                    "payload", "head",
                    F.concat("header", F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload")),
                             F.lit(b"\r\n\r\n")).alias("record")))


def record_payload(record, head):
    """The payload cut out of a record's bytes by its own lengths; NULL if they are not what the headers say.

    A record is the WARC header, a block of Content-Length bytes (the HTTP
    header and the payload) and two line ends.
    """
    start = F.octet_length(head)                   # up to the end of the HTTP header
    block = F.regexp_extract(head, r"(?m)^Content-Length: (\d+)\r?$", 1).cast("long")
    warc = F.locate("\r\n\r\n", head) + F.lit(3)    # characters, and bytes counted next
    warc = F.octet_length(F.substr(head, F.lit(1), warc))
    fits = (F.octet_length(record) == warc + block + F.lit(4)) & (
        F.substr(record, F.octet_length(record) - F.lit(3)) == F.lit(b"\r\n\r\n"))
    return F.when(fits, F.substr(record, start + F.lit(1), F.octet_length(record) - F.lit(4) - start))


def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the records of ``pages``, read them back, and return what the rebuilt records hold.

    A response's length and digest are those of the payload cut out of its
    rebuilt bytes; a revisit has none of its own and names the payload of the
    record it refers to.  A payload that does not have the digest that its
    header tells, or a record of another length, fails the job.
    """
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    back = read_archive(spark, path).withColumn("cut", record_payload(F.col("record"), F.col("head")))
    response = F.col("record_type") == "response"
    digest = F.when(response, F.sha2("cut", 256)).otherwise(F.col("payload_digest"))
    told = F.regexp_extract("head", r"(?m)^WARC-Payload-Digest: sha256:([0-9a-f]+)\r?$", 1)
    checked = F.when(F.coalesce(digest == told, F.lit(False)) & F.col("cut").isNotNull(), digest).otherwise(
        F.raise_error(F.lit("a record does not hold the payload that its header tells")))
    return back.select(
        F.col("record_id").alias("page_id"),
        F.when(response, F.octet_length("cut").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        checked.alias("payload_digest"), "record_type", "refers_to")


ARCHIVE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
