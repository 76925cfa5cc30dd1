import hashlib
import random

import numpy as np
from fixtures import docs
from pyspark.sql import functions as F

from barloom.llm import fim

ALPHABET = "aé€😀\n ́<S>\x7f\x80߿ࠀ￿\U00010000"


def texts():
    r = random.Random(4)
    made = ["".join(r.choice(ALPHABET) for _ in range(n)) for n in [*range(60), 1000, 5000]]
    return [None, "", "a", "😀", "has <P>", "<S>", "<M", "<", *made, *(t.replace("<S>", "<").replace("<", "ß") for t in made), "é" * 100_001]


def plainly(doc_id, text, o=fim.Options()):
    t = text or ""
    d = hashlib.sha256(f"{o.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    x, y = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(m in t for m in (o.prefix, o.suffix, o.middle)) or h[2] % 100 >= o.rate:
        return doc_id, len(t), "plain", None, None, t
    if h[3] % 100 < o.spm_rate:
        return doc_id, len(t), "spm", x, y - x, o.suffix + t[y:] + o.prefix + t[:x] + o.middle + t[x:y]
    return doc_id, len(t), "psm", x, y - x, o.prefix + t[:x] + o.suffix + t[y:] + o.middle + t[x:y]


def test_rank_and_select():
    for t in texts():
        raw = (t or "").encode()
        units = fim.Units(np.frombuffer(raw, np.uint8))
        ends = np.cumsum([len(c.encode()) for c in t or ""], dtype=int)
        assert units.select(np.arange(1, len(ends) + 1)).tolist() == ends.tolist()
        at = np.arange(len(raw) + 1)
        assert units.rank(at).tolist() == np.searchsorted(ends, at, side="right").tolist()


def test_against_code_points(spark, monkeypatch):
    rows = [(i, t, "en", "s", 0, *[None] * 18) for i, t in enumerate(texts())]
    rows += [rows[9], rows[9], (None, "without a number", "en", "s", 0, *[None] * 18)]
    for size in (fim.SLICE, 100):
        monkeypatch.setattr(fim, "SLICE", size)
        for options in (fim.Options(), fim.Options(7, 100, 50, "[pre|", "[suf|", "[mid|")):
            found = fim.transformed(docs(spark, rows), options)
            got = found.withColumn("back", fim.restored(F.col("output"), F.col("form"), options)).collect()
            want = [(*plainly(r[0], r[1], options), r[1] or "") for r in rows]
            assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fim.transformed(docs(spark, [])).count() == 0
