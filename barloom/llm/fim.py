"""Fill-in-the-middle: each text is cut in three at two drawn places and put together in another order.

Cuts count code points, texts are bytes.  A batch of texts is one UTF-8 buffer seen as 64-bit words: byte arithmetic marks the bytes
that end a code point, ``bitwise_count`` gives the marks of each word, and their running sum answers both questions by search, with no decoding:
how many code points a text has, and where its k-th one ends (find the word, then select the mark inside it).

A text that holds a marker, is empty or draws so stays plain.  The draws are the first four 8-digit groups of sha256(``seed:doc_id``), so that they do not
depend on order or partitioning.  Rows go through one map, in slices of at most ``SLICE`` bytes (one text, if it is longer).

Defined cases: a null text is empty; a null doc_id draws from ``seed:``; repeated rows give equal results each; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Batches, text_bytes

SLICE = 8 << 20
ONES, TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Options:
    """Seed of the draws, percent of texts that are transformed, percent of those in suffix-first form, markers."""

    seed: int = 1
    rate: int = 90
    spm_rate: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class Units:
    """Rank and select over the code points of a UTF-8 buffer of whole texts."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(8 * (len(data) // 8 + 1), np.uint8)
        padded[:len(data)] = data
        word = padded.view("<u8")
        first = (~word | (word << np.uint64(1))) & TOPS  # any byte but 10xxxxxx begins a code point
        following = np.append(first[1:], TOPS)
        self.ends = (first >> np.uint64(8)) | (following << np.uint64(56))  # a byte ends one if the next begins one
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that end before byte ``at``."""
        low = (np.uint64(1) << (np.uint64(8) * (at % 8).astype(np.uint64))) - np.uint64(1)
        return self.before[at // 8] + np.bitwise_count(self.ends[at // 8] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte after the k-th code point, k from 1."""
        at = np.searchsorted(self.before, k, side="left") - 1
        upto = (self.ends[at] >> np.uint64(7)) * ONES  # byte i: marks in bytes 0 to i
        reached = ((upto | TOPS) - (k - self.before[at]).astype(np.uint64) * ONES) & TOPS
        return 8 * at + 9 - np.bitwise_count(reached)


def _slices(lengths: np.ndarray):
    """Ranges of rows whose texts together take at most SLICE bytes."""
    i, total = 0, np.concatenate(([0], np.cumsum(lengths)))
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(total, total[i] + SLICE, side="right")) - 1)
        yield i, j
        i = j


def _transformed(options: Options):
    _, rate, spm_rate, *named = astuple(options)
    p, s, m = (x.encode() for x in named)

    def run(batches: Batches) -> Batches:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1])
            draws = [b.column(i).to_numpy() for i in (2, 3, 4, 5)]
            for i, j in _slices(lengths):
                part = texts.slice(i, j - i).to_pylist()
                data = b"".join(part)
                starts = np.concatenate(([0], np.cumsum(lengths[i:j])))
                units = Units(np.frombuffer(data, np.uint8))
                before = units.rank(starts)
                n = np.diff(before)
                h1, h2, h3, h4 = (x[i:j] for x in draws)
                one, two = h1 % (n + 1), h2 % (n + 1)
                one, two = np.minimum(one, two), np.maximum(one, two)
                cuts = [np.where(c > 0, units.select(before[:-1] + np.maximum(c, 1)), starts[:-1]) - starts[:-1] if len(data) else 0 * c for c in (one, two)]
                plain = (n == 0) | (h3 % 100 >= rate) | np.array([p in t or s in t or m in t for t in part], bool)
                form = np.where(plain, "plain", np.where(h4 % 100 < spm_rate, "spm", "psm"))
                made = [t if f == "plain" else p + t[:x] + s + t[y:] + m + t[x:y] if f == "psm" else s + t[y:] + p + t[:x] + m + t[x:y]
                        for t, f, x, y in zip(part, form.tolist(), cuts[0].tolist(), cuts[1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(one, pa.int64(), mask=plain),
                     pa.array(two - one, pa.int64(), mask=plain), pa.array(made, pa.binary()).cast(pa.string(), safe=False)],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars, output."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text_bytes().alias("t"), *[h.alias(f"h{i}") for i, h in enumerate(draws(doc_id, options.seed), 1)])
    return rows.mapInArrow(_transformed(options), OUT)


def restored(output: Column, form: Column, options: Options = Options()) -> Column:
    """The exact text, from an output and its form."""
    marks = "|".join(re.escape(x) for x in (options.prefix, options.suffix, options.middle))
    part = F.split(output, marks, -1)
    a, b, c = (F.get(part, i) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(a, c, b)).when(form == "spm", F.concat(b, c, a)).otherwise(output)
