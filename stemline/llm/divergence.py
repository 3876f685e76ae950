"""Divergence between the sources of a language, and the terms that set a source apart.

Each language keeps the terms of at least three of its documents; each of its sources has a smoothed
share of every kept term, in whole billionths.  The chi-square divergence of source s from source t sums
f(p, q) = floor((p - q)**2 / q) over all kept terms, though a source has few of them.  With a source's supports S and T it is

    V f(s0, t0) + sum over S of [f(a, t0) - f(s0, t0)] + sum over T of [f(s0, b) - f(s0, t0)]
    + sum over both of [f(a, b) - f(a, t0) - f(s0, b) + f(s0, t0)]

where s0 and t0 are the shares of a term that does not occur.  The constant needs no terms; the one-sided sums are
priced from each source's histogram of counts; only terms that two sources share are joined, by their
postings.  All values are whole numbers and exact, so nothing depends on an order of addition.

A task tallies its documents in memory and hands on sums, a flush at a time, so one row a
(language, source, term) and flush is shuffled, whatever the text.  A posting list has at most one row per source.

Defined results: null text, language or source count as ''; a group without terms has all ranks of part ``pair``; with no
kept term in the language all its values are 0; repeated rows count as often as they occur; ties go
to the item that sorts first as UTF-8; an empty table gives no rows.  Memory of a task grows with the distinct terms
of one document, not with its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemline.llm import textvec
from stemline.llm.scratch import cut, drop

LEAST, TOP, WHOLE, FLUSH = 3, 200, 1_000_000_000, 100_000
#: Lower-cases A-Z and blanks what is part of no term: all of ASCII but letters.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

BATCH = 20_000
BETWEEN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def tally(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", flush: int = FLUSH) -> DataFrame:
    """(lang, source, term, n, df): partial counts of occurrences and documents; a row with a null term names each group."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def rows(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (a, b), (n, df) in counts.items():
            every = [None, *n]
            for k in range(0, len(every), BATCH):
                terms = every[k : k + BATCH]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a] * len(terms)), pa.array([b] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([df[t] for t in terms], pa.int64())],
                    names=["lang", "source", "term", "n", "df"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for a, b, data, offsets in textvec.blocks(batch.column(2)):
                body, at = data.tobytes(), offsets.tolist()
                for i in range(b - a):
                    n, df = counts.setdefault(groups[a + i], (Counter(), Counter()))
                    size -= len(n)
                    seen: set[bytes] = set()
                    for words in textvec.word_lists(body, at[i], at[i + 1], TERMS, BETWEEN):
                        n.update(words)
                        seen.update(words)
                    df.update(seen)
                    size += len(n)
                    if size > flush:
                        yield from rows(counts)
                        counts, size = {}, 0
        yield from rows(counts)

    return docs.select(blank(lang), blank(source), F.col(text)).mapInArrow(run, "lang string, source string, term string, n long, df long")


def postings(counts: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, p, p0, q) of each kept term that occurs in a group, and (lang, source, p0, kept terms) of every group.

    p is the group's share of the term, p0 its share of a term that it lacks, q the language's."""
    of_term = W.partitionBy("lang", "term")
    known = counts.where("term IS NOT NULL").withColumns({"df": F.sum("df").over(of_term), "n_lang": F.sum("n").over(of_term), "first": F.min("source").over(of_term) == F.col("source")})
    kept = cut(known.where(F.col("df") >= least).drop("df"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.where("first").groupBy("lang").agg(F.sum("n_lang").alias("total_lang"), F.count("*").alias("terms"))
    groups = counts.where("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["total", "total_lang", "terms"])
    groups = cut(groups.withColumn("p0", share(F.lit(0), "total", "terms")))
    priced = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), "total", "terms").alias("p"), "p0", share(F.col("n_lang"), "total_lang", "terms").alias("q"))
    return priced, groups.select("lang", "source", "p0", "terms")


def share(n: Column, total: str, terms: str) -> Column:
    """1 + floor(10**9 (n + 1) / (total + terms)), in decimals beyond what a long holds; null without terms."""
    upper, lower = F.lit(WHOLE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), F.nullif(F.col(total) + F.col(terms), F.lit(0))
    return F.call_function("div", upper, lower.cast("decimal(20,0)")) + 1


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); shares are at most 10**9 + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def pairs(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of a language's sources."""
    f, col = excess, F.col
    mine, other = groups.withColumnRenamed("p0", "s0"), groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("t0"))
    apart = F.col("source") != F.col("item")
    constant = mine.join(other, "lang").where(apart).select("lang", "source", "item", F.coalesce(col("terms") * f(col("s0"), col("t0")), F.lit(0)).alias("value"))
    counts = priced.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    left = counts.withColumnRenamed("p0", "s0").join(other, "lang").where(apart).select("lang", "source", "item", (col("n") * (f(col("p"), col("t0")) - f(col("s0"), col("t0")))).alias("value"))
    right = counts.select("lang", col("source").alias("item"), "p", col("p0").alias("t0"), "n").join(mine, "lang").where(apart)
    right = right.select("lang", "source", "item", (col("n") * (f(col("s0"), col("p")) - f(col("s0"), col("t0")))).alias("value"))
    a = priced.select("lang", "term", "source", col("p").alias("a"), col("p0").alias("s0"))
    b = priced.select("lang", "term", col("source").alias("item"), col("p").alias("b"), col("p0").alias("t0"))
    both = f(col("a"), col("b")) - f(col("a"), col("t0")) - f(col("s0"), col("b")) + f(col("s0"), col("t0"))
    shared = a.join(b, ["lang", "term"]).where(apart).select("lang", "source", "item", both.alias("value"))
    every = constant.unionByName(left).unionByName(right).unionByName(shared)
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's divergence from the others, and the terms that it has most in excess."""
    partial = tally(docs, lang, source, text)
    counts = cut(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))
    priced, groups = postings(counts, least)
    ranked = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    # the rank is cut to the top within tasks before rows are shuffled
    parts = [("pair", ranked(pairs(priced, groups))), ("term", ranked(terms).where(F.col("rank") <= top))]
    found = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in parts]
    out = cut(found[0].unionByName(found[1]))
    drop(counts, groups, priced)
    return out
