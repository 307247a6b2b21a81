"""What every order of a set of filters removes, and each filter's Shapley share, from counts of coalitions."""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BLANK, saved

FILTERS = "ABCDE"
#: Limits of the four filters on a text alone.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"
BLANKS = " \t\n\x0b\x0c\r"


def text_failures(text: Column) -> list[Column]:
    """Failure of each filter that needs the text alone, in order: few words, repeated words, capitals, symbols."""
    trimmed = F.trim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        n < LEAST_WORDS,
        distinct.cast("long") * 100 < n.cast("long") * DISTINCT_PERCENT,
        capitals.cast("long") * 100 > F.length(text).cast("long") * CAPITAL_PERCENT,
        text.rlike(SYMBOLS),
    ]


def as_mask(failures: list[Column]) -> Column:
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failures)), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail, at most 32 rows a part.

    Bit i of ``mask`` is set if the i-th filter fails. Only a digest of each text moves. Rows are counted per identifier and
    text before they meet the labels, and per text and part before the copies of a text meet, so a text or a missing
    identifier that a third of all rows share is a few rows by then. A row fails the copy filter if its text also has a
    smaller doc_id; a row without doc_id never does, and rows that share the smallest doc_id do not.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), as_mask(text_failures(text)).alias("mask")
    )
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    rows = saved(rows, "failures")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_doc"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = rows.where("doc_id is not null").join(marks, F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    known = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    rows = known.unionByName(rows.where("doc_id is null").withColumns({c: F.lit(False) for c in ("good", "toxic")}))
    # Rows of one doc_id and text differ at most in their part, so the least doc_id of a group comes with its count.
    group = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))).alias("n_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    least = F.expr("min(least.doc_id) over (partition by digest)")
    group = group.withColumn("first", least)
    copies = F.coalesce(F.col("n_id") - F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0), F.lit(0))
    both = F.array(
        F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")),
        F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), F.col("copies").alias("n")),
    )
    split = group.withColumn("copies", copies).select("part", "good", "toxic", F.inline(both)).where("n > 0 or mask < 16")
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def solved(rows: list[list[Fraction]]) -> list[list[Fraction]]:
    """Gauss-Jordan elimination in exact rationals: what is left right of a square system."""
    n = len(rows)
    for i in range(n):
        pivot = next(k for k in range(i, n) if rows[k][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n):
            if k != i and rows[k][i]:
                rows[k] = [a - rows[k][i] * b for a, b in zip(rows[k], rows[i], strict=True)]
    return [r[n:] for r in rows]


def shapley_coefficients(n: int = len(FILTERS)) -> list[list[int]]:
    """Per filter, the whole factor of each coalition's removals in n! times its Shapley value.

    The values minimise the sum over coalitions S of w(S) * (v(S) - sum of the values in S) ** 2 with the kernel weights
    w(S) = (n - 1) / (C(n, |S|) * |S| * (n - |S|)), subject to their sum being v(all). The normal equations, bordered by
    that constraint, are solved once for every coalition's unit vector in rationals.
    """
    size = 1 << n
    inner = range(1, size - 1)
    weight = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in inner}
    rows = []
    for i in range(n):
        gram = [sum((weight[s] for s in inner if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)]
        right = [weight[s] if s in weight and s >> i & 1 else Fraction(0) for s in range(size)]
        rows.append([*gram, Fraction(1), *right])
    rows.append([*[Fraction(1)] * n, Fraction(0), *[Fraction(s == size - 1) for s in range(size)]])
    values = [[x * factorial(n) for x in row] for row in solved(rows)[:n]]
    if any(x.denominator != 1 for row in values for x in row):
        raise ArithmeticError("the coefficients of the Shapley values are not whole")
    return [[int(x) for x in row] for row in values]


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from counts (part, mask, n, good, toxic) by failure mask.

    All coalitions' removals are tabulated; every step is a difference of two of them and the shares are their combination.
    """
    n, size = len(filters), 1 << len(filters)
    every = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    removed = counts.select("*", every.alias("coalition")).groupBy("part", "coalition").agg(
        *[F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")], F.sum("n").alias("all")
    )
    table = removed.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("coalition", "n", "good", "toxic"))).alias("v"), F.max("all").alias("total"))
    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append({"filter_order": "".join(filters[k] for k in order), "step": step, "i": i, "before": before, "after": before | 1 << i})
            before |= 1 << i
    at = lambda k, c: F.get(F.col("v"), F.lit(k) if isinstance(k, int) else k)[c]
    whole = ", ".join("array(" + ", ".join(f"{c}L" for c in row) + ")" for row in shapley_coefficients(n))
    shares = F.expr(f"transform(array({whole}), c -> aggregate(zip_with(c, v, (k, s) -> k * s.n), 0L, (a, x) -> a + x))")
    own = F.array(*[at(1 << i, "n") for i in range(n)])
    lone = F.array(*[at(size - 1, "n") - at((size - 1) & ~(1 << i), "n") for i in range(n)])
    table = table.select("part", "v", "total", shares.alias("shares"), own.alias("own"), lone.alias("lone"))
    rows = table.select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, i: int, before: int, after: int>>")))
    lost = {c: at(F.col("after"), c) - at(F.col("before"), c) for c in ("n", "good", "toxic")}
    pick = lambda name: F.get(name, F.col("i"))
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - at(F.col("after"), "n")).alias("kept"), lost["n"].alias("removed"),
        (pick("own") - lost["n"]).alias("redundant"), pick("lone").alias("unique_fails"), lost["good"].alias("good_lost"),
        lost["toxic"].alias("toxic_lost"), pick("shares").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: the effect of five
    filters in all 120 orders, per value of ``part``.

    A: under 200 words; B: fewer distinct words than half of all; C: over 2 capitals in 100 characters; D: one of #$%&*|;
    E: a text that a smaller doc_id also has, anywhere. Null text is empty and a null part is ''. Repeated rows count as
    often as they occur. Where labels repeat a doc_id, it is good (or toxic) if one of them says so; rows without doc_id have
    no label. ``shapley`` is the filter's removals summed over all orders. An empty table gives no rows; other columns,
    whatever their names, are ignored.
    """
    return interactions(failure_counts(docs, labels, part))
