"""URL filters: a cascade of Bloom filters over the complete set of keys of a corpus, in DataFrame functions only.

Level 0 holds the listed keys, level 1 the other keys that pass level 0, level 2 the listed keys that pass level 1, and so on, until a
level lets none of the opposite kind through.  For every key of the corpus, the first level that it fails gives an exact answer: an even level
says "not listed", an odd one "listed".  A level is one array of 64-bit words, built by a grouped ``bit_or`` and read through a scalar
subquery, so that looking up a url is a few array reads inside the scan's own stage and no join.

Size: level 0 takes ``BITS_PER_KEY`` bits per listed key; a list of more than ``MAX_LISTED`` keys is refused, which bounds
a level at 20 MB.  Levels fall off geometrically.

Rules are (host, path) pairs written ``host/path``; one fits its host and all subdomains when the path starts with the rule's, and the longest
fitting rule wins over the cascade.  Defined cases: a null url or one without ``://`` has an empty host and path, which no rule
fits; repeated rows are judged each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpointed

BITS_PER_KEY, HASHES, MAX_LISTED, MAX_LEVELS = 12, 4, 10_000_000, 40
#: Name parts that put a host on the default list.
LISTED_PARTS = ("spam", "casino", "pills", "viagra", "porn", "malware", "phishing", "warez")
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later, longer ones are asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def listed_host(host: Column, parts: Sequence[str] = LISTED_PARTS) -> Column:
    return F.coalesce(host.rlike("|".join(parts)), F.lit(False))


def _positions(key: Column, level: int, size: int) -> list[Column]:
    """Bit positions of a key in the filter of a level, by two hashes."""
    a, b = (F.pmod(F.xxhash64(key, F.lit(2 * level + i)), F.lit(size)) for i in (0, 1))
    return [F.pmod(a + F.lit(i) * b, F.lit(size)) for i in range(HASHES)]


class Cascade:
    """Filters of the levels; ``contains`` is exact for every key of the corpus it was built over."""

    def __init__(self, filters: list[tuple[DataFrame, int]]):
        self.filters = filters

    def contains(self, key: Column) -> Column:
        answer = F.lit(len(self.filters) % 2 == 1)
        for level in range(len(self.filters) - 1, -1, -1):
            answer = F.when(self.passes(key, level), answer).otherwise(F.lit(level % 2 == 1))
        return answer

    def passes(self, key: Column, level: int) -> Column:
        found, size = self.filters[level]
        words = found.select("words").scalar()
        hits = [F.getbit(F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1
                for p in _positions(key, level, size)]
        out = hits[0]
        for h in hits[1:]:
            out = out & h
        return out


def _filter(keys: DataFrame, level: int, n: int) -> tuple[DataFrame, int]:
    """One row with the level's words.  At most n * HASHES positions, of which equal words meet before the shuffle."""
    size = 64 * max(16, -(-n * BITS_PER_KEY // 64))
    spark = keys.sparkSession
    bits = keys.select(F.explode(F.array(*_positions(F.col("key"), level, size))).alias("p"))
    bits = bits.select(F.floor(F.col("p") / 64).cast("int").alias("at"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("word"))
    empty = spark.range(size // 64).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("word"))
    words = bits.unionByName(empty).groupBy("at").agg(F.bit_or("word").alias("word"))
    listed = words.agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("all"))  # size / 64 rows, bounded by MAX_LISTED
    return checkpointed(listed.select(F.col("all.word").alias("words"))), size


def build(universe: DataFrame) -> Cascade:
    """``universe``: key, listed (boolean), one row per key."""
    universe = checkpointed(universe)
    filters: list[tuple[DataFrame, int]] = []
    kind, rest = True, universe
    while True:
        wanted = rest.filter(F.col("listed") == kind).select("key")
        n = wanted.count()
        if n > MAX_LISTED:
            raise ValueError(f"{n} keys at level {len(filters)}; the filter's size is only bounded up to {MAX_LISTED}")
        if n == 0:
            break
        if len(filters) == MAX_LEVELS:
            raise ValueError("the cascade does not end; are there keys that are listed and not listed?")
        filters.append(_filter(wanted, len(filters), n))
        passed = Cascade(filters).passes(F.col("key"), len(filters) - 1)
        # keys of this kind went on only if they passed the levels before; of the other kind, those that pass this one remain
        rest = rest.filter((F.col("listed") == kind) | passed)
        kind = not kind
    return Cascade(filters)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, parts: Sequence[str] = LISTED_PARTS) -> DataFrame:
    """page_id, host, path, rule, listed, verdict.  The list is every (host, path) of a host with one of ``parts`` in its name."""
    host, path = url_parts(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    key = F.concat("host", "path")
    universe = urls.groupBy(key.alias("key")).agg(F.bool_or(listed_host(F.col("host"), parts)).alias("listed"))
    found = build(universe)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = urls.withColumns({"rule": rule, "_v": verdict, "listed": found.contains(key)})
    return judged.select("page_id", "host", "path", "rule", "listed",
                         F.coalesce("_v", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
