"""Exact quantiles of many columns at once, without a buffer per group.

Values are counted per group, column and value first, so a group of any size is as many rows as it has distinct values.
These are dealt to ordered pieces (``windows.Ordered``), which cut a group that holds over two tasks' share; running sums of
the counts give the ranks of every value, and only the values at the wanted ranks go on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.windows import Ordered
from quire.session import materialised


def quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]], weight: Column | None = None, counted: bool = False) -> DataFrame:
    """keys and one double per name of ``wanted`` (name -> column, probability), interpolated between neighbouring ranks.

    ``weight`` is how often a row counts (default: once; at least 1). Nulls do not count; a column that is null in a whole
    group has null quantiles if another has values there, and a group without any value has no row. Null keys are a group.
    The counts are written to the shared folder once; ``counted`` says that ``df`` is such a table already, with one row per
    group and value.
    """
    names = list(dict.fromkeys(c for c, _ in wanted.values()))
    cells = F.array(*[F.struct(F.lit(i).alias("_m"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(names)])
    once = F.lit(1).cast("long") if weight is None else weight.cast("long")
    counts = df.select(*keys, once.alias("_w"), F.inline(cells)).where("_x is not null")
    if not counted:
        counts = materialised(counts.groupBy(*keys, "_m", "_x").agg(F.sum("_w").alias("_w")), "value-counts")
    pieces = Ordered(counts, [*keys, "_m"], ["_x"])
    rows = pieces.running(pieces.rows, sums={"_upto": F.col("_w")}, totals={"_n": F.col("_w")}).drop("_slot")

    def rank(p: float) -> Column:
        return F.lit(p) * (F.col("_n") - 1)

    def holds(c: str, at: Column) -> Column:
        return (F.col("_m") == names.index(c)) & (F.col("_upto") > at) & (F.col("_upto") - F.col("_w") <= at)

    low = {n: holds(c, F.floor(rank(p))) for n, (c, p) in wanted.items()}
    high = {n: holds(c, F.ceil(rank(p))) for n, (c, p) in wanted.items()}
    used = F.array_contains(F.array(*low.values(), *high.values()), True)
    found = rows.where(used).groupBy(*keys).agg(
        *[F.max(F.when(low[n], F.col("_x"))).alias(f"_l_{n}") for n in wanted],
        *[F.max(F.when(high[n], F.col("_x"))).alias(f"_h_{n}") for n in wanted],
        *[F.max(F.when(low[n], rank(p) - F.floor(rank(p)))).alias(f"_f_{n}") for n, (_, p) in wanted.items()],
    )
    between = [(F.col(f"_l_{n}") * (1 - F.col(f"_f_{n}")) + F.col(f"_h_{n}") * F.col(f"_f_{n}")).alias(n) for n in wanted]
    return found.select(*keys, *between)
