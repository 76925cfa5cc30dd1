"""Corpus pipeline: quality, exact copies, near copies, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; what it returns is written as Parquet and read again.
All but the last return the columns of documents, extra ones included.  Null texts count as empty, very long ones are taken whole, and empty tables give empty
results in every stage; a null doc_id is a document like any other, whose label is unknown.  Of repeated or equal rows one stays after the second stage.

* quality: the pairwise ranking is fitted on the labelled rows outside the held-out fold; rows below the threshold go.
* exact: of texts equal but for the case of A-Z, the row with the largest doc_id stays.
* near: SimHash fingerprints of the five-word shingle sets propose links through op10's byte-position index, and lists of rare shingles the pairs at 0.8 that 3 bits
  do not reach; every link is verified by the Jaccard similarity of the sets, 0.8 or more, counted exactly.  Of a group the row with the smallest doc_id stays.
* mix: the words taken for each source, a row for each run of neighbouring blocks of a document (in each round through its source).
* pack: token pieces of the mix with their sequence and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import likeness, mixing, naming, packing, ranking
from barloom.llm.common import NO_ID, keep_rows, scratch, table

#: The near stage's shingle width and likeness; five words and 0.8 are the convention for near copies.
NEAR = {"shingle": 5, "similarity": 0.8}


def _kept(groups: DataFrame) -> DataFrame:
    return groups.filter("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_rk_id"), "_rk_h")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = ranking.learn(docs, table(sf_dir, "labels", spark))
    return ranking.scored(docs, model, "_quality").filter(F.col("_quality") >= ranking.CUT).drop("_quality")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_rows(docs, _kept(naming.exact_groups(docs)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_rows(docs, _kept(likeness.near_groups(docs, **NEAR)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]
#: Tokens, fingerprints and the fitted model are beyond SQL; tests/llm compares each stage with a plain form of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, "documents", spark)
    for name, stage in STAGES[:-1]:
        at = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
