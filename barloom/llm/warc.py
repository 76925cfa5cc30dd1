"""WARC archives as segment rows: written and read by Spark, with no whole record in one value on the way back.

A record's payload is cut into segments of at most ``SEGMENT`` code points; the first is a response record, the others are WARC
continuation records that name the record and their segment number (WARC 1.1, record segmentation).  Every row of the written
text files is one segment.  The read side splits the files at ``WARC/1.1`` lines, so the writer also cuts inside
any such line of a payload, and inside one that the end of a part would complete, and writes the mark's slash in a url as ``%2F``; what is in a page therefore
never splits a row.  Payloads of one segment are digested where they are parsed.
Segments of longer ones meet by (record, segment number) and pass one by one through a running SHA-1: memory holds a segment.

Payloads are equal if their SHA-256 and length are; SHA-1 is the digest that the archive carries.  Among records of one payload of at least ``LEAST`` bytes, the one with the largest page_id is the response and the others are revisit
records that point to it and carry no payload.  Smaller payloads are always responses.

Defined cases: a null html is an empty payload; repeated rows of the largest page_id are all responses; a null page_id is below all
others; null urls are left out of the header; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import Batches, salted_join, scratch, to_batch

SEGMENT = 1 << 20
LEAST = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MARK, NL = "WARC/1.1\r\n", "\r\n"
#: Inside the mark of a payload, where it stands on a line's end or would get one from what follows the part.
CUT = r"(?<=WARC/)(?=1\.1(?:\r\n|\z))"
OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _payloads(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload")).withColumns(
        {"digest": F.sha1(F.col("payload").cast("binary")), "name": F.sha2(F.col("payload").cast("binary"), 256), "bytes": F.octet_length("payload").cast("long")})


def _field(name: str, value) -> F.Column:
    """Header line, or nothing when the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(NL)), F.lit(""))


def _name(page_id) -> F.Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, segment: int = SEGMENT, least: int = LEAST) -> None:
    """Write one WARC file per task below ``path``."""
    spark = pages.sparkSession
    found = _payloads(pages)
    twins = found.filter(F.col("bytes") >= least).groupBy("name", "bytes").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    at = scratch(spark, "warc-twins")
    # a written table has a known size: the planner copies it to all tasks only below its own limit
    twins.filter("n > 1").select("name", "bytes", "top").write.parquet(at)
    met = salted_join(found, spark.read.parquet(at), ["name", "bytes"], F.struct("page_id", "url"))
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    met = met.select("page_id", "url", "payload", "digest", "bytes", F.when(revisit, F.col("top")).alias("top"), F.monotonically_increasing_id().alias("row"))
    starts = F.sequence(F.lit(0), F.greatest(F.length("payload") - 1, F.lit(0)), F.lit(segment))
    parts = F.flatten(F.transform(starts, lambda i: F.split(F.substring("payload", i + 1, F.lit(segment)), CUT)))
    rows = met.withColumn("parts", F.when(F.col("top").isNull(), parts).otherwise(F.array(F.lit(""))))
    rows = rows.select("page_id", "url", "digest", "bytes", "top", "row", F.size("parts").alias("of"), F.posexplode("parts").alias("pos", "part"))
    first, last = F.col("pos") == 0, F.col("pos") + 1 == F.col("of")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "), F.col("bytes").cast("string"), F.lit(NL * 2))
    block = F.when(first, F.concat(http, "part")).otherwise(F.col("part"))
    kind = F.when(~first, "continuation").when(F.col("top").isNotNull(), "revisit").otherwise("response")
    many = F.col("of") > 1
    head = F.concat(
        F.lit(MARK), _field("WARC-Type", kind), _field("WARC-Record-ID", F.when(first, _name(F.col("page_id"))).otherwise(
            F.concat(F.lit("<urn:x-row:"), F.col("row").cast("string"), F.lit(":"), F.col("pos").cast("string"), F.lit(">")))),
        _field("X-Row", F.col("row").cast("string")), _field("WARC-Date", F.lit(DATE)), _field("WARC-Target-URI", F.replace(F.regexp_replace("url", r"[\r\n]", "%0A"), F.lit("WARC/"), F.lit("WARC%2F"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _field("WARC-Segment-Number", F.when(many, (F.col("pos") + 1).cast("string"))),
        _field("WARC-Segment-Origin-ID", F.when(~first, _name(F.col("page_id")))),
        _field("WARC-Segment-Total-Length", F.when(many & last, (F.col("bytes") + F.octet_length(http)).cast("string"))),
        _field("WARC-Profile", F.when(F.col("top").isNotNull(), F.lit(PROFILE))), _field("WARC-Refers-To", F.when(F.col("top").isNotNull(), _name(F.col("top")))),
        _field("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))), _field("Content-Length", F.octet_length(block).cast("string")), F.lit(NL))
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", NL * 2).text(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row per record segment: header fields and the part of the payload; a block of another length than its header says is an error."""
    raw = spark.read.option("lineSep", MARK).text(path).filter(F.length("value") > 0)
    raw = raw.withColumn("head", F.substring_index("value", NL * 2, 1)).withColumn("size", F.length("head"))
    raw = raw.withColumn("block", F.substring(F.col("value"), F.col("size") + 5, F.greatest(F.length("value") - F.col("size") - 8, F.lit(0))))

    def field(name: str, pattern: str = r"([^\r\n]*)"):
        got = F.regexp_extract(F.concat(F.lit(NL), "head", F.lit(NL)), rf"\r\n{name}: {pattern}\r\n", 1)
        return F.when(got != "", got)

    def page(name: str):
        return field(name, r"<urn:x-page:(-?\d+)>").cast("long")

    kind = field("WARC-Type")
    size = F.octet_length("block").cast("string")
    block = F.when(size == field("Content-Length"), F.col("block")).otherwise(
        F.raise_error(F.concat(F.lit("block length differs from its header: "), "head")).cast("string"))
    return raw.select(
        kind.alias("kind"), F.when(kind == "continuation", page("WARC-Segment-Origin-ID")).otherwise(page("WARC-Record-ID")).alias("page_id"),
        field("X-Row").cast("long").alias("row"), F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(0)).alias("number"),
        page("WARC-Refers-To").alias("refers_to"), field("WARC-Payload-Digest", r"sha1:([0-9a-f]+)").alias("digest"), block.alias("block"),
    ).withColumns({
        "http_bytes": F.when(F.col("kind") != "continuation", F.regexp_extract(F.substring_index("block", NL * 2, 1), r"Content-Length: (\d+)", 1).cast("long")),
        "part": F.when(F.col("kind") == "continuation", F.col("block")).otherwise(
            F.expr(r"substring(block, length(substring_index(block, '\r\n\r\n', 1)) + 5)")),
    }).drop("block")


def _running(batches: Batches) -> Batches:
    """Sorted (row, number) segments in; one row per record out, its digest and length carried from segment to segment."""
    key, page, sha, n = None, None, None, 0
    names = ("page_id", "payload_bytes", "payload_digest")
    kinds = (pa.int64(), pa.int64(), pa.string())

    def made(out: list[tuple]):
        cols = list(zip(*out, strict=True)) if out else [()] * 3
        return to_batch({a: (list(c), k) for a, c, k in zip(names, cols, kinds, strict=True)})

    for batch in batches:
        out = []
        for row, _, p, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row != key:
                if sha is not None:
                    out.append((page, n, sha.hexdigest()))
                key, page, sha, n = row, p, hashlib.sha1(), 0
            sha.update(part)
            n += len(part)
        yield made(out)
    if sha is not None:
        yield made([(page, n, sha.hexdigest())])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (recomputed from the payload; of a revisit from its header), record_type, refers_to."""
    seen = read_segments(spark, path)
    whole = seen.filter("number = 0").select(
        "page_id", F.when(F.col("kind") == "revisit", F.col("http_bytes")).otherwise(F.octet_length("part")).cast("long").alias("payload_bytes"),
        F.when(F.col("kind") == "revisit", F.col("digest")).otherwise(F.sha1(F.col("part").cast("binary"))).alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to")
    cut = seen.filter("number > 0").select("row", "number", "page_id", F.col("part").cast("binary").alias("part"))
    cut = cut.repartition("row").sortWithinPartitions("row", "number")
    cut = cut.mapInArrow(_running, "page_id long, payload_bytes long, payload_digest string")
    return whole.unionByName(cut.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}))
