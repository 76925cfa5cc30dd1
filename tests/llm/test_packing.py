import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import doc_rows, docs
from tokenizers import Tokenizer

from barloom.llm import packing

VOCABULARY = packing.default_vocabulary()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def test_same_ids_as_the_tokenizer_file(tokenizer):
    r = random.Random(0)
    parts = ["a", "Éa", " ", "  ", "\n", "\n\n", "\t", ".", "!!", "###", "don't", "12", "ß", "\u00a0", "\u2003", "日本", "x.\ny", "\r\n", "<b>", "🙂", "'s"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)] + ["", " ", "  ", "a ", " a", "a \n b", "\n a"]
    for t in texts:
        got = np.frombuffer(packing.token_ids(t, VOCABULARY), "<u4").tolist()
        assert got == tokenizer.encode(t, add_special_tokens=False).ids, json.dumps(t)


def test_added_tokens_have_the_ids_of_the_tokenizer_file(tokenizer):
    r = random.Random(3)
    end = "<|endoftext|>"
    parts = ["a", " ", "  ", "\n", ".", "don't", "12", "日本", "<|", "|>", "endoftext", end, end, end.upper(), end[:-1], "<" + end]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)] + [end, f"end of doc{end}next one", f" {end} ", f"a  {end}\n\nb", end * 3]
    assert sum(end in t for t in texts) > 1000
    for t in texts:
        got = np.frombuffer(packing.token_ids(t, VOCABULARY), "<u4").tolist()
        assert got == tokenizer.encode(t, add_special_tokens=False).ids, json.dumps(t)


def slow_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if capacity - b >= n]
        if fit:
            bins[bins.index(max(fit))] += n
        else:
            bins.append(n)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    r = random.Random(1)
    for capacity in (1, 7, 64, 1024):
        for _ in range(15):
            lengths = [r.randint(1, capacity) if r.random() < 0.7 else capacity // 3 + 1 for _ in range(r.randint(0, 300))]
            counts = {n: lengths.count(n) for n in set(lengths)}
            fill = {}
            for length, first, last, seq, offset in packing.plan(counts, capacity):
                for i in range(last - first + 1):
                    assert fill.get(seq + i, 0) == offset
                    fill[seq + i] = offset + length
            assert sorted(fill.values()) == slow_best_fit(lengths, capacity)
            assert all(v <= capacity for v in fill.values())


def test_pack_covers_every_id_once(spark, tokenizer):
    capacity = 128
    got = packing.pack(packing.pieces(docs(spark), capacity), capacity).toPandas()
    rows = doc_rows()
    want = []
    for d, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        n = len(ids)
        first = n - (-(-n // capacity) - 1) * capacity
        cuts = [0, *range(first, n + 1, capacity)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    have = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(have, key=key) == sorted(want, key=key)
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert x.offset.tolist() == [0, *np.cumsum(x.length)[:-1].tolist()]
        assert x.length.sum() <= capacity
    assert got.sequence_id.nunique() == len(slow_best_fit(got.length.tolist(), capacity))


def test_empty_table(spark):
    assert packing.pack(packing.pieces(docs(spark, []))).count() == 0
