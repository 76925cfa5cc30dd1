"""Small tables with the cases every operator must stand: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

import random

WORDS = [f"w{i}" for i in range(300)]
#: Column names that the operators use inside.
CLASH = {"score": "double", "size": "long", "block": "string", "rid": "long", "kept": "boolean", "name": "string", "level": "int", "fp": "binary", "length": "long",
         "piece": "int", "_salt": "int", "epoch": "long", "start": "long", "t": "string", "h": "long", "target": "double", "words": "long", "bucket": "int"}
DOC_KIND = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} {t}" for n, t in CLASH.items())
EXTRA = (0.5, 7, "x", 3, True, "n", 2, b"f", 9, 4, 1, 2, 5, "t", 6, 1.5, 8, 3)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def doc_rows():
    base = prose(1, 90)
    swapped = base.split()
    swapped[40] = "other"
    long = prose(2, 30_000)
    texts = [
        (1, base, "a"), (2, base.upper(), "a"), (3, " ".join(swapped), "b"), (4, None, None), (5, "", "a"), (6, " \t\n ", "b"), (7, long, "b"), (8, long + " end", None),
        (9, "Ünï cöde É tèxt", "é"), (9, "Ünï cöde É tèxt", "é"), (None, prose(3, 60), "a"), (None, prose(3, 60), "a"), (10, "one", "a"), (11, "one two", "b"),
        (12, prose(4, 200), "b"), (13, prose(5, 200), "c"), (14, prose(5, 200).capitalize(), "c"), (9, "another text of nine", "é"), (-5, prose(6, 128), "a"),
    ] + [(100 + i, prose(50 + i, 40 + 7 * i), "hot" if i % 3 else "a") for i in range(40)] + [(200 + i, prose(7, 50), "hot") for i in range(30)]
    return [(d, t, "en", s, len(t or ""), *EXTRA) for d, t, s in texts]


def docs(spark, rows=None):
    return spark.createDataFrame(doc_rows() if rows is None else rows, DOC_KIND)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, b"p") for r in rows], "page_id long, url string, html string, digest string, row long, payload binary")


def ascii_lower(t):
    return (t or "").encode().lower().decode()
