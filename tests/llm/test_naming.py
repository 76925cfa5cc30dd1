import hashlib
from collections import defaultdict

import pytest
from fixtures import ascii_lower, doc_rows, docs

from barloom.llm import naming


def expected(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[ascii_lower(t)].append(d)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        top = max(known) if known else None
        out += [(i, top, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return out


# a block of 16 bytes gives deep levels; a hash of five values makes almost all blocks share one
@pytest.mark.parametrize(("block", "hasher"), [(4096, naming.hash64), (16, naming.hash64), (64, lambda b: len(b) % 5)])
def test_groups_match_plain_grouping(spark, block, hasher):
    rows = [r for r in doc_rows() if block > 16 or len(r[1] or "") < 5000]
    got = naming.exact_groups(docs(spark, rows), block, hasher).collect()
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(expected(rows), key=key)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_prefixes_and_block_orders_differ(spark):
    b = "x" * 16
    texts = [b * 3, b * 4, b * 3 + "y", "y" * 16 + b * 2, b + "y" * 16 + b, b * 2 + "y" * 16, b, b * 2]
    rows = [(i, t, "en", "s", 0, *doc_rows()[0][5:]) for i, t in enumerate(texts)]
    assert {r.group_size for r in naming.exact_groups(docs(spark, rows), 16).collect()} == {1}


def test_empty_table(spark):
    assert naming.exact_groups(docs(spark, [])).count() == 0
