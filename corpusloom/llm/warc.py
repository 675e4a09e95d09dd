"""A content-addressed WARC archive: payloads stored once, record headers apart.

An archive is two tables in one folder. `objects` holds each payload's bytes once under
their SHA-256. `headers` holds, per record, the exact bytes of its WARC header and of
its HTTP header, and the SHA-256 that leads to the payload. Records are rebuilt by
joining both; a payload whose digests do not match its record stops the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.layout import computed
from corpusloom.sources.scratch import stored

# Fixed values of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of `payload` as 32 upper-case base32 characters."""
    digest = F.sha1(payload)
    # Ten hex digits are forty bits, eight base32 characters.
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _line(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, date: str, min_bytes: int = 0) -> None:
    """Write a record per row of `pages` (page_id, url, html) to the archive at `path`.

    Payload is the html in UTF-8, empty if null. Of records with equal payloads of at
    least `min_bytes` bytes the least page_id is a response and the others revisit it;
    shorter ones are all responses. A null id comes last; rows that repeat id and
    payload are all responses. A null url leaves its line out; blanks and control
    characters in a url become %20. Other columns are not looked at; no rows give an
    empty archive.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", key.alias("key"), payload.alias("payload"))
    rows = computed(rows, digest=F.unhex(F.sha2("payload", 256)))
    facts = rows.select(
        "page_id", "url", "digest", F.length("payload").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1")
    )
    facts = stored(facts, "record-facts")
    first = stored(facts.groupBy("digest").agg(F.min("page_id").alias("first_id")), "first-records")

    # Ids differ within a digest, so a payload held by very many records is no hot key.
    # Rows that repeat the first record are dropped by the join's own keys and layout.
    owners = first.select("digest", F.coalesce(F.col("first_id").cast("string"), F.lit("")).alias("key"))
    objects = rows.select("digest", "key", "payload").join(owners, ["digest", "key"])
    objects.dropDuplicates(["digest", "key"]).select("digest", "payload").write.parquet(f"{path}/objects")

    known = facts.join(first, "digest")
    revisit = (F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\n"),
        _line("Content-Type", "text/html; charset=utf-8"),
        _line("Content-Length", F.col("bytes").cast("string")),
        F.lit("\r\n"),
    )
    block = F.length(F.encode("http", "utf-8")) + F.when(revisit, 0).otherwise(F.col("bytes"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    warc = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", date),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(
            revisit, F.concat(_line("WARC-Profile", PROFILE), _line("WARC-Refers-To", _record_id(F.col("first_id"))))
        ).otherwise(""),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
    )
    headers = known.withColumn("http", http).select("digest", warc.alias("warc"), "http")
    headers.write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive, rebuilt: warc, http (exact header text), payload, digest.

    `payload` is the full payload, also of a revisit. Digests and length are taken anew
    from the payload and must equal the SHA-256 it lies under and what the record's
    headers say, or the read fails.
    """
    headers = spark.read.parquet(f"{path}/headers")
    objects = spark.read.parquet(f"{path}/objects")
    filed = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    records = computed(headers.join(objects, "digest", "left"), sha1=base32_sha1(F.col("payload")), filed=filed)
    said = header_field("warc", "WARC-Payload-Digest")
    length = F.regexp_extract("http", r"(?md)^Content-Length: (\d+)\r$", 1).cast("long")
    sound = F.col("filed") & (said == F.concat(F.lit("sha1:"), "sha1")) & (length == F.length("payload"))
    bad = F.raise_error(F.concat(F.lit("payload does not match its record: "), "warc"))
    return records.withColumn("warc", F.when(sound, F.col("warc")).otherwise(bad)).drop("filed")


def header_field(header: str, name: str) -> Column:
    """Value of a header line, null if the header lacks it."""
    return F.nullif(F.regexp_extract(header, f"(?md)^{name}: ([^\\r\\n]*)\\r$", 1), F.lit(""))


def page_of(record_id: Column) -> Column:
    """The page_id in a record id of this archive."""
    return F.nullif(F.regexp_extract(record_id, "^<urn:page:(.*)>$", 1), F.lit(""))


def record_bytes(records: DataFrame) -> Column:
    """The record as it stands in a WARC file, without the closing blank lines."""
    block = F.when(header_field("warc", "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat(F.col("warc").cast("binary"), F.col("http").cast("binary"), block)


def export_warc(records: DataFrame, path: str) -> None:
    """Write rebuilt records as plain .warc text parts, ready for other tools."""
    # The text writer puts bytes out as they are; its line end closes each record.
    rows = records.select(record_bytes(records).cast("string").alias("value"))
    rows.write.option("lineSep", RECORD_END).text(path)


def page_records(records: DataFrame, id_type: str = "long") -> DataFrame:
    """What each record says of its page: id, payload size and digest, type, referred page."""
    return records.select(
        page_of(header_field("warc", "WARC-Record-ID")).cast(id_type).alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.substring(header_field("warc", "WARC-Payload-Digest"), 6, 32).alias("payload_digest"),
        header_field("warc", "WARC-Type").alias("record_type"),
        page_of(header_field("warc", "WARC-Refers-To")).cast(id_type).alias("refers_to"),
    )
