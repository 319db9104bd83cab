"""Content-addressed WARC archive: payloads once by digest, exact record headers, records by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelbom.llm.common import store

#: The base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a hex text whose bits are a multiple of five."""
    value = F.conv(F.substring(digest, 1, 5), 16, 10)
    parts = []
    for k in range(8):
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substr(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _compress(batches):
    import pyarrow as pa
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    for b in batches:
        packed = [packer.compress(x.as_buffer()) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["page_id", "sha256", "packed"])


def _records(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    return pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"),
        F.unhex(F.sha2(payload, 256)).alias("sha256"), base32_of_hex(F.sha1(payload)).alias("digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """Archive a table (page_id, url, html) under ``path``.

    ``headers`` holds one row per record: page_id, sha256 and the exact WARC header block. ``payloads``
    holds one row per distinct payload: its SHA-256, SHA-1 and length, and its bytes as a zstandard
    frame. Of records with equal payloads of ``least_bytes`` or more, that with the largest page_id is
    the response and the others are revisits that refer to it; records with smaller payloads are all
    responses. Rows that repeat a page_id and a payload have equal records; a null page_id is written
    as ``none`` and never refers to another.

    Digests alone decide which record is what; only one pass carries payloads, compressed, to the join
    that keeps one of each, dealt by digest and page so that many copies of a page do not meet.
    """
    records = _records(pages)
    slim = store(records.drop("payload"), "records")
    last = store(slim.groupBy("sha256").agg(F.max("page_id").alias("last")), "digests")

    def urn(c):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))

    revisit = F.coalesce((F.col("payload_bytes") >= least_bytes) & (F.col("page_id") < F.col("last")), F.lit(False))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id")),
        F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", uri)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn("last")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit("\r\n"),
    )
    slim.join(last, "sha256").select("page_id", "sha256", F.encode(header, "utf-8").alias("header")).write.parquet(f"{path}/headers")

    packed = records.select("page_id", "sha256", "payload").mapInArrow(_compress, "page_id long, sha256 binary, packed binary")
    kept = last.select(F.col("sha256").alias("s"), F.col("last").alias("l"))
    once = packed.join(kept, (F.col("sha256") == F.col("s")) & F.col("page_id").eqNullSafe(F.col("l")), "left_semi")
    once.dropDuplicates(["sha256", "page_id"]).select("sha256", "packed").write.parquet(f"{path}/payloads")


def _rebuild(batches):
    import hashlib

    import pyarrow as pa
    import zstandard

    for b in batches:
        rows, size = [], 0
        for page_id, digest, header, packed in zip(*(b.column(k) for k in range(4))):
            payload = zstandard.ZstdDecompressor().decompress(packed.as_py())
            if hashlib.sha256(payload).digest() != digest.as_py():
                raise ValueError(f"payload of page {page_id} does not have its digest")
            rows.append((page_id.as_py(), header.as_py() + payload + b"\r\n\r\n"))
            size += len(payload)
            if size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))], ["page_id", "record"])
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))], ["page_id", "record"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): every original record, byte for byte: header, payload, two line ends.

    Headers are joined to payloads by digest. Payloads are unique there, so the headers of a payload
    that many pages share can be split over tasks. Every payload is checked against its digest.
    """
    headers = spark.read.schema("page_id long, sha256 binary, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("sha256 binary, packed binary").parquet(f"{path}/payloads")
    both = headers.join(payloads, "sha256").select("page_id", "sha256", "header", "packed")
    return both.mapInArrow(_rebuild, "page_id long, record binary")


def _parse(batches):
    import base64
    import hashlib

    import pyarrow as pa

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def page(urn):
        name = urn.removeprefix("<urn:page:").removesuffix(">") if urn else "none"
        return None if name == "none" else int(name)

    for b in batches:
        out = []
        for record in b.column(0):
            raw = record.as_py()
            head, _, rest = raw.partition(b"\r\n\r\n")
            version, *lines = head.decode("utf-8").split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            n = int(fields["Content-Length"])
            payload, end = rest[:n], rest[n:]
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if version != "WARC/1.1" or end != b"\r\n\r\n" or fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                raise ValueError(f"bad record {fields.get('WARC-Record-ID')}")
            out.append((page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), n, digest, fields["WARC-Type"], page(fields.get("WARC-Refers-To"))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names)


def parse_records(records: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of whole WARC records.

    Length and digest are taken from the payload; a record that does not agree with its header fails.
    """
    return records.select("record").mapInArrow(
        _parse, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def export_warc(records: DataFrame, path: str) -> None:
    """Write records as WARC files, one after the other.

    A record ends in two line ends, so Spark's text writer with that separator writes the format as it
    is, to any store. Records of payloads that are not valid UTF-8 do not fit a text file.
    """
    body = F.decode(F.expr("substring(record, 1, length(record) - 4)"), "utf-8")
    records.select(body.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
