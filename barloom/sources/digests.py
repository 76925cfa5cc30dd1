"""SHA-256 of files of any size, block by block.

Files of at most ``BLOCK`` bytes are digested whole where they are read.  A larger file is read in Spark's splits and laid down in blocks; in
each round one block of every such file continues the digest's state that the round before left, and each file has a task of its own.  So no task reads more
than a block or a split, however large, many or split the files are, and only a state of 112 bytes goes from round to round.  The digest is a chain, so the
rounds grow with the largest file.

Spark has no source of byte ranges but lines: splits are read as lines by byte 10 and joined again, and the length of the file tells whether
it ends with one and whether it began with the byte order mark that the line reader leaves out.  Two cases stay whole in a task, with a limit of 2 GB:
files named as compressed, which the line reader would unpack, and a stretch without a byte 10.
"""

from __future__ import annotations

import _hashlib
import ctypes
from functools import partial
from itertools import takewhile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import Batches, forget, scratch

C = F.col
#: Bytes of a file that one round digests, and of a piece of them (of smaller blocks, an eighth).
BLOCK, PIECE = 128 << 20, 1 << 20
#: Names that Hadoop's line reader takes for compressed files.
PACKED = ("gz", "bz2", "deflate", "lz4", "snappy", "zst", "xz")
MARK = b"\xef\xbb\xbf"
STATE = 112


def _packed(name: Column) -> Column:
    return name.rlike(rf"\.({'|'.join(PACKED)})$")


def _decoded(text: Column) -> Column:
    """A name or path of the metadata, which have them as in a URL."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _folder(path: Column, depth: int) -> Column:
    """The folders of a file below the first ``depth``, empty if it lies in the last of these."""
    steps = F.split(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/")
    return F.array_join(F.slice(steps, F.lit(depth + 2), F.greatest(F.size(steps) - depth - 2, F.lit(0))), "/")


def _depth(spark: SparkSession, path: str) -> int:
    """How many folders deep the part of a path before its first wildcard is."""
    fixed = "/".join(takewhile(lambda step: not set(step) & set("*?[{\\"), path.split("/")))
    at = spark._jvm.org.apache.hadoop.fs.Path(fixed or ("/" if path.startswith("/") else "."))
    at = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at)
    return at.toUri().getPath().rstrip("/").count("/")


def _crypto():
    """The C library behind hashlib, whose SHA256_CTX is plain memory."""
    lib = ctypes.CDLL(_hashlib.__file__)
    if not hasattr(lib, "SHA256_Update"):
        raise RuntimeError("hashlib's library has no SHA256_Update; files above one block need it")
    return lib


def begun() -> bytes:
    state = ctypes.create_string_buffer(STATE)
    _crypto().SHA256_Init(state)
    return state.raw


def continued(state: bytes, pieces: list[bytes]) -> bytes:
    lib, at = _crypto(), ctypes.create_string_buffer(state, STATE)
    for piece in pieces:
        lib.SHA256_Update(at, ctypes.c_char_p(piece), ctypes.c_size_t(len(piece)))
    return at.raw


def ended(state: bytes) -> str:
    out = ctypes.create_string_buffer(32)
    _crypto().SHA256_Final(out, ctypes.create_string_buffer(state, STATE))
    return out.raw.hex()


def _pieces(batches: Batches, size: int) -> Batches:
    """Lines (path, start, value) joined to pieces of ``size`` bytes or more (path, start, seq, at, n, bytes); ``at`` are the bytes of the split before a piece."""
    key, seq, held, at, n = None, 0, [], 0, 0
    names = ["path", "start", "seq", "at", "n", "bytes"]

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([seq], pa.int64()), pa.array([at], pa.int64()),
                                           pa.array([n], pa.int64()), pa.array([b"".join(held)], pa.binary())], names)

    for b in batches:
        for path, start, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != (path, start) or n >= size:
                if held:
                    yield piece()
                seq, at = (seq + 1, at + n) if key == (path, start) else (0, 0)
                held, n = [], 0
                key = (path, start)
            held += (line, b"\n")
            n += len(line) + 1
    if held:
        yield piece()


def _advance(states: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
    """A file's state after its pieces of one block; what is beyond its length, the byte 10 after a last line without one, is left out."""
    out = states.copy()
    if len(states) and len(pieces):
        at, left = states.iloc[0], int(states.iloc[0]["left"])
        fed = []
        for piece in pieces.sort_values(["start", "seq"])["bytes"]:
            fed.append(bytes(piece[:left]))
            left -= len(fed[-1])
        out["state"], out["left"] = [continued(at["state"], fed)], [left]
    return out


def large_digests(spark: SparkSession, path: str, block: int) -> DataFrame:
    """path, file, bytes, sha256 of the files above ``block`` bytes, in rounds."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata")
    lines = lines.filter((C("_metadata.file_size") > block) & ~_packed(C("_metadata.file_name")))
    raw = lines.select(C("_metadata.file_path").alias("path"), C("_metadata.file_block_start").alias("start"), C("value").cast("binary").alias("value"))
    at = scratch(spark, "digest")
    pieces = raw.mapInArrow(partial(_pieces, size=min(PIECE, block // 8)), "path string, start long, seq long, at long, n long, bytes binary")
    # by the piece's place, not its split's: a split may be longer than a block, or begin near the end of one
    pieces.withColumn("part", F.expr(f"(start + at) div {block}")).write.option("compression", "none").partitionBy("part").parquet(f"{at}/pieces")
    pieces = spark.read.parquet(f"{at}/pieces")
    files = lines.select("_metadata.file_path", "_metadata.file_name", "_metadata.file_size").distinct().toDF("path", "file", "bytes")
    files = files.withColumn("file", _decoded(C("file")))
    found = files.join(pieces.groupBy("path").agg(F.sum("n").alias("n")), "path").withColumn("mark", C("n") < C("bytes"))
    found = found.withColumn("odd", C("bytes") - C("n") - F.when(C("mark"), len(MARK)).otherwise(0))
    found = found.withColumn("odd", F.when(C("odd").isin(0, -1), False).otherwise(F.raise_error(F.concat(F.lit("not read whole: "), C("path"))).cast("boolean")))
    state = F.when(C("mark"), F.lit(continued(begun(), [MARK]))).otherwise(F.lit(begun()))
    left = C("bytes") - F.when(C("mark"), len(MARK)).otherwise(0)
    number = (F.row_number().over(Window.orderBy("path")) - 1).alias("no")  # over one row a file
    found.filter(~C("odd")).select("path", number, "file", "bytes", left.alias("left"), state.alias("state")).write.parquet(f"{at}/state-0")
    states = spark.read.parquet(f"{at}/state-0")
    numbers = F.broadcast(spark.read.parquet(f"{at}/state-0").select("path", "no"))
    most, n = states.agg(F.max("bytes"), F.count(F.lit(1))).first()
    for k in range(-(-(most or 0) // block)):
        here = pieces.filter(C("part") == k).join(numbers, "path").select("no", "start", "seq", "bytes").repartitionById(n, "no")
        states = states.repartitionById(n, "no").groupBy("no").cogroup(here.groupBy("no")).applyInPandas(_advance, states.schema)
        states.write.parquet(f"{at}/state-{k + 1}")
        states = spark.read.parquet(f"{at}/state-{k + 1}")
    forget(spark, f"{at}/pieces")
    final = F.udf(lambda s, n: ended(bytes(s)) if not n else None, "string")
    return states.select(_decoded(C("path")).alias("path"), "file", "bytes", F.coalesce(final("state", "left"), F.raise_error(F.concat(F.lit("not read whole: "), C("path")))).alias("sha256"))


def digests(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """file, bytes, sha256 and folder (below the path, or below what comes before a glob's first wildcard) of every file; Spark's listing leaves empty files out."""
    files = spark.read.format("binaryFile").load(path)
    # by names in the listing: what only a filter on the path leaves out would be read first
    packed = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(PACKED)}}}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    whole = files.filter(C("length") <= block).unionByName(packed.filter(C("length") > block))
    found = whole.select("path", name.alias("file"), C("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if not files.select("path", "length").filter((C("length") > block) & ~_packed(name)).isEmpty():
        found = found.unionByName(large_digests(spark, path, block))
    return found.select("file", "bytes", "sha256", _folder(C("path"), _depth(spark, path)).alias("folder"))
