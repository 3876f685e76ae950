"""Secret scans through a trigram index, in built-in expressions only.

Each rule is a regular expression.  ``trigram_query`` derives from it the conjunctions of
trigrams that any match must hold (a disjunction of conjunctions, letters in lower case).
Rules that have such a query are looked up in an inverted index of just those trigrams:
postings are (trigram, document), a conjunction intersects them, and only the documents
that remain are verified.  Rules without mandatory trigrams scan every document.

Defined results: a null text is empty; spans are in code points with exclusive ends, in
order of start and then of the rules; matches of one rule don't overlap, those of
different rules may; repeated and tied rows are reported each, null keys included; an empty
table gives no rows; further columns pass ``scan`` and ``redact`` untouched, whatever their names;
rules that all lack trigrams need no index.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemline.llm.scratch import fresh_name, text_of


@dataclass(frozen=True)
class Rule:
    """``least`` is the least length of group ``group``; shorter matches are consumed and dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base rules.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pay", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url", r"[a-z][a-z0-9+]{2,9}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[A-Za-z0-9.-]+"),
)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams of which any match holds all of one; empty if there are none.

    Walks the parsed expression; what isn't a literal breaks the literal run, and a group of
    alternatives multiplies the runs.  Optional literals give both forms."""
    parser, consts = re._parser, re._constants

    def add(runs: list[list[str]], more: str) -> list[list[str]]:
        return [[*r[:-1], r[-1] + more] for r in runs]

    def walk(items, runs: list[list[str]]) -> list[list[str]]:
        for op, arg in items:
            if op is consts.LITERAL:
                runs = add(runs, chr(arg).lower())
            elif op is consts.SUBPATTERN:
                runs = walk(arg[3], runs)
            elif op is consts.BRANCH:
                runs = [x for way in arg[1] for x in walk(way, [list(r) for r in runs])]
            elif op in (consts.MAX_REPEAT, consts.MIN_REPEAT) and arg[:2] == (0, 1) and len(runs) < 16:
                runs = [list(r) for r in runs] + walk(arg[2], [list(r) for r in runs])
            elif op in (consts.MAX_REPEAT, consts.MIN_REPEAT) and arg[0] >= 1 and all(x is consts.LITERAL for x, _ in arg[2]):
                once = "".join(chr(x).lower() for _, x in arg[2])
                runs = [[*r, once[-2:]] for r in add(runs, once * arg[0])]
            elif op is consts.IN and 1 < len(arg) <= 6 and all(x is consts.LITERAL for x, _ in arg) and len(runs) < 16:
                runs = [x for _, c in arg for x in add([list(r) for r in runs], chr(c).lower())]
            else:
                runs = [[*r, ""] for r in runs]
        return runs

    ways = {frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)) for runs in walk(list(parser.parse(pattern)), [[""]])}
    if frozenset() in ways:
        return []
    return sorted((w for w in ways if not any(o < w for o in ways)), key=sorted)


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, at, kind>> of a rule's matches: the pieces between matches give the positions."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    parts = F.zip_with(gaps, F.transform(whole, F.char_length), lambda gap, n: F.struct(n.alias("n"), (gap + n).alias("sum")))
    passed = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.char_length(g) >= rule.least)
    # the last gap has no match after it
    ends = running(F.transform(F.slice(parts, 1, F.size(whole)), lambda p: p["sum"]), lambda x, y: x + y)
    rows = F.filter(F.arrays_zip(ends.alias("end"), F.transform(whole, F.char_length).alias("n"), passed.alias("ok")), lambda x: x["ok"])
    found = F.transform(rows, lambda x: F.struct((x["end"] - x["n"]).alias("start"), x["end"].alias("end")))
    return F.when(F.size(whole) > 0, found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """The array of ``values`` added up from the first, by doubling: n log n steps for n values, where growing an array takes n squared."""
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")
    before = lambda s, i, k: F.get(s, i - F.call_function("shiftleft", F.lit(1), k))
    step = lambda s, k: F.transform(s, lambda x, i: F.coalesce(add(before(s, i, k), x), x))
    return F.aggregate(F.sequence(F.lit(0), rounds), values, step)


def pieces(text: Column, gaps: Column, size: int = 4096) -> Column:
    """The array of text[a:b] of ``gaps`` (a, b), from chunks of ``size`` characters, so that no piece is sought from the beginning."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    def cut(chunks: Column, g: Column) -> Column:
        first, last = F.floor(g["a"] / size).cast("int"), F.floor((g["b"] - 1) / size).cast("int")
        of = lambda c: F.substring(F.get(chunks, c), F.greatest(g["a"] - c * size, F.lit(0)) + 1, F.least(g["b"] - c * size, F.lit(size)) - F.greatest(g["a"] - c * size, F.lit(0)))
        return F.when(g["a"] < g["b"], F.array_join(F.transform(F.sequence(first, last), of), "")).otherwise("")

    return bound(chunks, lambda c: F.transform(gaps, lambda g: cut(c, g)))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of ``value`` as a variable, so that it is found once and not for each element of an array that f works through."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _named(rows: Column, at: int, kind: str) -> Column:
    return F.transform(rows, lambda s: F.struct(s["start"].alias("start"), F.lit(at).alias("at"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def postings(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """The inverted index of docs (key, text), restricted to the trigrams that some rule asks for: (gram int, bit long, key)."""
    entry = lambda i: F.struct(F.lit(i).alias("gram"), F.lit(1 << i % 63).cast("long").alias("bit"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), entry(i)) for i, t in enumerate(trigrams)]))
    # a projection of its own: the text is put in lower case once, not for each trigram
    return docs.where("text is not null").select("key", F.lower("text").alias("low")).select("key", F.inline(held))


def candidates(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(key, hits) of docs (key, text): bit r is set where the postings of one conjunction of rule r all hold the key."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries for way in q for t in way})
    words = (len(trigrams) + 62) // 63
    index = postings(docs, trigrams)
    bits = [F.bit_or(F.when((F.col("gram") >= 63 * w) & (F.col("gram") < 63 * w + 63), F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)]
    held = index.groupBy("key").agg(*bits)

    def intersect(way: frozenset[str]) -> Column:
        ids = [trigrams.index(t) for t in way]
        masks = [sum(1 << (i - 63 * w) for i in ids if i // 63 == w) for w in range(words)]
        return reduce(lambda a, b: a & b, [F.col(f"w{w}").bitwiseAND(F.lit(m).cast("long")) == m for w, m in enumerate(masks) if m])

    hits = F.lit(0)
    for r, query in enumerate(queries):
        found = reduce(lambda a, b: a | b, [intersect(way) for way in query])
        hits = hits + F.when(found, F.lit(1 << r)).otherwise(F.lit(0))
    return held.select("key", hits.alias("hits")).where("hits <> 0")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = BASE + ADDED, found: str = "found") -> DataFrame:
    """``docs`` and a column ``found``: array<struct<start, at, end, kind>> in order of start and rule; it takes the place of one of that name."""
    indexed = [r for r in rules if trigram_query(r.pattern)]
    name, hits = fresh_name(docs, "_row", "_hits")
    joined = docs.withColumn(hits, F.lit(0))
    if indexed:
        # rows are told apart by a hash of key and text, so that null keys don't meet in one task; rows of equal hashes share candidates, which are verified
        named = docs.withColumn(name, F.xxhash64(key, text))
        known = candidates(named.select(F.col(name).alias("key"), F.col(text).alias("text")), indexed).toDF(name, hits)
        joined = named.join(known, name, "left").drop(name)
    body = text_of(text)
    none = F.array().cast("array<struct<start:int,end:int>>")
    each = []
    for at, rule in enumerate(rules):
        got = spans(body, rule)
        if rule in indexed:
            got = F.when(F.coalesce(F.col(hits), F.lit(0)).bitwiseAND(1 << indexed.index(rule)) != 0, got).otherwise(none)
        each.append(_named(got, at, rule.kind))
    return joined.withColumn(found, F.array_sort(F.concat(*each))).drop(hits)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = BASE + ADDED, mark: str = "<secret>") -> DataFrame:
    """``docs`` with each maximal covered run of ``text`` replaced by ``mark``; a null text stays null."""
    (found,) = fresh_name(docs, "_found")
    (chunked, upto) = fresh_name(docs, "_chunks", "_upto")
    farthest = running(F.transform(F.col(found), lambda x: x["end"]), lambda x, y: F.greatest(x, y))
    spanned = scan(docs, key, text, rules, found).withColumn(upto, farthest)
    # a run begins where a span starts at or after the end of all before it
    gap = lambda u: F.transform(found, lambda x, i: F.struct(F.coalesce(F.get(u, i - 1), F.lit(0)).alias("a"), x["start"].alias("b")))
    gaps = F.filter(bound(F.col(upto), gap), lambda g: g["b"] >= g["a"])
    tail = F.struct(F.get(F.col(upto), F.size(upto) - 1).alias("a"), F.char_length(text).alias("b"))
    marked = spanned.withColumn(chunked, F.when(F.size(found) > 0, F.concat(gaps, F.array(tail))))
    clean = F.array_join(pieces(F.col(text), F.col(chunked)), mark)
    return marked.withColumn(text, F.when(F.size(found) > 0, clean).otherwise(F.col(text))).drop(found, chunked, upto)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    line = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        key, *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"),
    )
