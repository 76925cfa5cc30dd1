"""Language-model scores by cross-entropy difference.

Two bigram models over one vocabulary (the ids of a public tokenizer), with the same order, smoothing and discount: the target model counts
documents labelled of good quality, the background model counts all documents.  A document's score is the mean, over its tokens, of background
loss minus target loss: positive where the target model expects its tokens more.

Documents are dealt into blocks by hash.  Each block counts its own bigrams; the counts of a bigram are added up over blocks and
go back to the blocks that hold it, so a block is scored against exactly the part of both models that it needs.  No n-gram table is
broadcast: only figures per single token are (three counts in each model for at most 65,536 ids).

Defined cases: a null text is empty, has no token and scores 0; rows without doc_id belong to the background only; repeated rows count each;
with no target document the target model is the uniform one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpointed, salted_join
from barloom.llm.packing import default_vocabulary, token_ids

VOCABULARY, START, BITS = 50_257, 65_535, 16
DISCOUNT = 0.75
MODELS = ("n_background", "n_target")
#: Characters of a block: what a task holds at once, but for a longer single document.
BLOCK_CHARS = 16_000_000


def bigrams(text: str, vocabulary: str) -> np.ndarray:
    """previous id * 65536 + id for each token."""
    ids = np.frombuffer(token_ids(text, vocabulary), "<u4").astype(np.int64)
    return (np.concatenate(([START], ids[:-1])) << BITS | ids) if len(ids) else ids


def _count(vocabulary: str):
    def run(docs: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        good = set(targets["doc_id"])
        parts: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty((0, 2), np.int64))]
        held, n = [], 0

        def add() -> None:
            keys, at = np.unique(np.concatenate([parts[0][0], *[g for g, _ in held]]), return_inverse=True)
            weight = np.concatenate([parts[0][1], *[np.repeat([[1, t]], len(g), axis=0) for g, t in held]])
            sums = np.stack([np.bincount(at, weight[:, i], len(keys)) for i in (0, 1)], axis=1).astype(np.int64)
            parts[0] = (keys, sums)
            held.clear()

        for d, t in zip(docs["doc_id"], docs["text"], strict=True):
            g = bigrams(t, vocabulary)
            held.append((g, int(d in good)))
            n += len(g)
            if n > 2_000_000:
                add()
                n = 0
        if held:
            add()
        keys, sums = parts[0]
        block = docs["block"].iloc[0] if len(docs) else 0
        return pd.DataFrame({"block": np.full(len(keys), block, np.int64), "pair": keys, "n_background": sums[:, 0], "n_target": sums[:, 1]})
    return run


def losses(tokens: np.ndarray, pairs: np.ndarray, counts: np.ndarray, model: int) -> np.ndarray:
    """Interpolated absolute discounting over an add-one unigram model.

    ``tokens[model]``: count, context total and distinct continuations of each id.
    """
    count, contexts, kinds = tokens[model]
    before, now = pairs >> BITS, pairs & ((1 << BITS) - 1)
    single = (count[now] + 1) / (count.sum() + VOCABULARY)
    context = contexts[before]
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * kinds[before] * single) / context
    return -np.log(np.where(context > 0, seen, single))


def _score(vocabulary: str, tokens):
    def run(docs: pd.DataFrame, slice_: pd.DataFrame) -> pd.DataFrame:
        slice_ = slice_.sort_values("pair")
        pairs = slice_["pair"].to_numpy()
        both = np.stack([losses(tokens.value, pairs, slice_[c].to_numpy(), i) for i, c in enumerate(MODELS)])
        out = []
        for d, t in zip(docs["doc_id"], docs["text"], strict=True):
            at = np.searchsorted(pairs, bigrams(t, vocabulary))
            n = len(at)
            back, goal = (both[:, at].mean(axis=1) if n else (0.0, 0.0))
            out.append((d, n, goal, back, back - goal))
        done = pd.DataFrame(out, columns=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])
        done["doc_id"] = done["doc_id"].astype("Int64")
        return done
    return run


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, vocabulary: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score; ``targets``: the doc_id of target documents."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-chars // block_chars))

    def block(of) -> F.Column:
        return F.pmod(F.xxhash64(of), F.lit(n_blocks)).cast("long")

    # rows without a number are dealt by text
    docs = docs.withColumn("block", block(F.coalesce("doc_id", F.xxhash64("text"))))
    good = targets.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("block", block(F.col("doc_id")))
    counts = docs.groupBy("block").cogroup(good.groupBy("block")).applyInPandas(_count(vocabulary), "block long, pair long, n_background long, n_target long")
    counts = checkpointed(counts)
    totals = checkpointed(counts.groupBy("pair").agg(F.sum("n_background").alias("n_background"), F.sum("n_target").alias("n_target")))
    tokens = np.zeros((2, 3, 1 << BITS))
    for r in totals.groupBy(F.expr(f"pair & {(1 << BITS) - 1}").cast("int").alias("id")).agg(*[F.sum(c).alias(c) for c in MODELS]).collect():
        for i, c in enumerate(MODELS):
            tokens[i, 0, r.id] = r[c]
    by_context = totals.groupBy(F.expr(f"pair >> {BITS}").cast("int").alias("id")).agg(
        *[F.sum(c).alias(c) for c in MODELS], *[F.sum((F.col(c) > 0).cast("long")).alias(f"k_{c}") for c in MODELS])
    for r in by_context.collect():  # at most one row per id of the vocabulary
        for i, c in enumerate(MODELS):
            tokens[i, 1:, r.id] = r[c], r[f"k_{c}"]
    needed = salted_join(counts.select("block", "pair"), totals, ["pair"], F.col("block"), "inner")
    given = docs.groupBy("block").cogroup(needed.groupBy("block"))
    return given.applyInPandas(_score(vocabulary, spark.sparkContext.broadcast(tokens)),
                               "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
