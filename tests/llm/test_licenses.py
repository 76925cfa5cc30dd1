import re

from fixtures import docs, prose

from barloom.llm import licenses

MIT = licenses.NOTICES[0].text
SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plainly(text):
    """All fields by loops over places and templates."""
    w = words(text)
    places, base, labels, score = [], set(), set(), 0.0
    for t in licenses.TEMPLATES:
        tw, votes = t.words, {}
        for p in range(len(w)):
            for i in range(t.grams):
                if w[p:p + t.k] == tw[i:i + t.k]:
                    votes.setdefault(p - i, []).append((i, p))
        clusters, before = [], None
        for d in sorted(votes):
            if t.exact or before is None or d - before > licenses.SLACK:
                clusters.append([])
            clusters[-1] += votes[d]
            before = d
        for c in clusters:
            cover = len({i for i, _ in c}) / t.grams
            score = max(score, cover)
            start, stop = min(p for _, p in c), max(p for _, p in c) + t.k
            if t.exact and cover == 1:
                assert w[start:stop] == tw
                places.append(start)
                base.add(t.label)
                labels.add(t.label)
            elif not t.exact and cover >= licenses.LEAST and stop - start <= licenses.STRETCH * len(tw):
                labels.add(t.label)
    for t in licenses.PHRASES:  # the phrases by plain comparison
        assert sum(w[p:p + len(t.words)] == t.words for p in range(len(w))) == sum(w[p:p + len(t.words)] == t.words for p in places)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 6)


def test_against_loops(spark):
    moved = MIT.split()
    moved[20:20] = ["very", "new"]
    del moved[40]
    texts = [
        None, "", "...", "mit", "MIT license", "the MIT  License, mit-license; mit license's", "permit license", "mité license", "general public license general public", "public license",
        "GNU General Public License. Apache License mit license", MIT, MIT.upper(), " ".join(moved), " ".join(MIT.split()[:20]), " ".join(MIT.split()[::2]),
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0.", "licensed under cc by 4 0", prose(3, 20_000) + " Apache License " + prose(4, 20_000), "mit license " * 5000,
        f"{prose(1, 30)}\n{MIT}\n{prose(2, 30)}\n{licenses.NOTICES[3].text}", "İ K mit license", "a", "license mit license", "\x00mit\x7flicense\x01", "MIİT license",
        " ".join(f"{w} x y" for w in MIT.split()),
    ]
    rows = [(i, t, "en", "s", 0, *[None] * 18) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[5], "en", "s", 0, *[None] * 18), (None, texts[5], "en", "s", 0, *[None] * 18), (5, texts[11], "en", "s", 0, *[None] * 18)]
    got = licenses.scanned(docs(spark, rows)).collect()
    want = [(r[0], *plainly(r[1])) for r in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert plainly(" ".join(moved))[5] == "mit" and plainly(texts[17])[5] == "cc-by-nc-sa"
    assert licenses.scanned(docs(spark, [])).count() == 0


def test_plan_is_native(spark):
    plan = licenses.scanned(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
