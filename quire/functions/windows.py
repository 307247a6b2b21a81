"""Ordered per-key computations that survive a hot key.

A plain window puts every row of a key into one task. ``Ordered`` samples the rows' keys and order values once and cuts
each key that holds far more than a task's share into pieces at sampled splitters. Rows then move once, to their piece (a key that
is not hot is one piece), windows run inside pieces, and what a piece needs from those before it — sums so far, last known
values, the row before — is a prefix scan over one row per piece of the hot keys. No key, bucket or rate is named by the
caller, and rows without an order value are split like any others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled rows that stand for one piece.
PER_PIECE = 32
_SEED = 17


class Ordered:
    """Rows of ``df`` dealt to pieces of (keys, order), ready for ``running``; null keys are a key of their own.

    There are about as many pieces as the shuffle has partitions, which a cluster sets in proportion to its input: a key is
    cut if it holds over two pieces' share of the rows. ``order`` must tell the rows of a key apart; rows that agree in all
    of it stay together. ``like`` are other rows to take the sample from, if those of ``df`` are costly to compute (they need
    the keys and the order, and about the same shares); the sample only decides where rows are computed.

    The sample is read and counted when the object is made. It keeps at most one splitter per piece, so what is broadcast to
    find a row's piece, and the carries of the pieces, are bounded by the number of shuffle partitions whatever the data.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], like: DataFrame | None = None):
        self.keys, self.order, self.columns = list(keys), list(order), df.columns
        self.spark = df.sparkSession
        self.bounds = self._splitters(df if like is None else like)
        key = F.struct(*[F.col(k) for k in keys])
        if self.bounds is None:
            self.rows = df.withColumn("_slot", F.struct(key.alias("key"), F.lit(0).alias("piece")))
            return
        found = df.withColumn("_key", key).join(F.broadcast(self.bounds), "_key", "left")
        piece = F.coalesce(_position(F.col("_bounds"), F.struct(*self.order)), F.lit(0))
        self.rows = found.withColumn("_slot", F.struct(F.col("_key").alias("key"), piece.alias("piece"))).select(*df.columns, "_slot")

    def _splitters(self, df: DataFrame) -> DataFrame | None:
        """_key, _bounds: the hot keys' sorted splitters; None without a hot key."""
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        total = df.count()
        if not total or width < 2:
            return None
        picked = df.select(F.struct(*self.keys).alias("_key"), F.struct(*self.order).alias("_at"))
        picked = picked.sample(min(1.0, PER_PIECE * width / total), _SEED)
        key = Window.partitionBy("_key")
        picked = picked.withColumn("_n", F.count("*").over(key)).where(F.col("_n") >= 2 * PER_PIECE)
        picked = picked.withColumn("_r", F.row_number().over(key.orderBy("_at"))).where(F.col("_r") % PER_PIECE == 0)
        found = picked.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_r", "_at"))).alias("_s"))
        found = found.select("_key", F.transform("_s", lambda x: x["_at"]).alias("_bounds"))
        table = found.toArrow()
        return self.spark.createDataFrame(table, found.schema) if table.num_rows else None

    def running(
        self,
        rows: DataFrame,
        *,
        sums: dict[str, Column] | None = None,
        lasts: dict[str, Column] | None = None,
        prevs: dict[str, Column] | None = None,
        totals: dict[str, Column] | None = None,
    ) -> DataFrame:
        """``rows`` (self.rows, or what came of them with ``_slot`` kept) with running values.

        sums:  name -> value; running total up to and including the row
        lasts: name -> value; last non-null value up to and including the row
        prevs: name -> value; value of the row before (null on a key's first row)
        totals: name -> value; sum over all rows of the key

        Rows stay in their piece, so a second call moves nothing.
        """
        sums, lasts, prevs, totals = sums or {}, lasts or {}, prevs or {}, totals or {}
        values = {**sums, **lasts, **prevs, **totals}
        kept = rows.columns
        rows = rows.withColumns({f"_v_{n}": c for n, c in values.items()})
        local = Window.partitionBy("_slot").orderBy(*self.order)
        upto = local.rowsBetween(Window.unboundedPreceding, 0)
        out = rows.select(
            *kept,
            *[F.sum(f"_v_{n}").over(upto).alias(f"_l_{n}") for n in sums],
            *[F.last(f"_v_{n}", ignorenulls=True).over(upto).alias(f"_l_{n}") for n in lasts],
            *[F.lag(f"_v_{n}").over(local).alias(f"_l_{n}") for n in prevs],
            *[F.sum(f"_v_{n}").over(Window.partitionBy("_slot")).alias(f"_l_{n}") for n in totals],
            *([F.lag(F.lit(1)).over(local).alias("_inner")] if prevs and self.bounds is not None else []),
        )
        if self.bounds is None:
            return out.select(*kept, *[F.coalesce(f"_l_{n}", F.lit(0)).alias(n) for n in sums], *[F.col(f"_l_{n}").alias(n) for n in [*lasts, *prevs, *totals]])
        carry = self._carry(rows, sums, lasts, prevs, totals)
        out = out.join(F.broadcast(carry), "_slot", "left")
        first = F.col("_inner").isNull()
        return out.select(
            *kept,
            *[(F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in sums],
            *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in lasts],
            *[F.when(first, F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}")).alias(n) for n in prevs],
            *[F.coalesce(f"_c_{n}", f"_l_{n}").alias(n) for n in totals],
        )

    def _carry(self, rows: DataFrame, sums: dict, lasts: dict, prevs: dict, totals: dict) -> DataFrame:
        """_slot and what stands before it in its key, for the pieces of hot keys: at most one row per piece."""
        at = F.struct(*self.order)
        hot = rows.join(F.broadcast(self.bounds.select(F.col("_key").alias("_hot"))), F.col("_slot.key") == F.col("_hot"), "left_semi")
        ends = hot.groupBy("_slot").agg(
            *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in [*sums, *totals]],
            *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_t_{n}") for n in lasts],
            *[F.max_by(f"_v_{n}", at).alias(f"_t_{n}") for n in prevs],
        )
        before = Window.partitionBy("_slot.key").orderBy("_slot.piece").rowsBetween(Window.unboundedPreceding, -1)
        scan = ends.select(
            "_slot",
            *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
            *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
            *[F.last(f"_t_{n}").over(before).alias(f"_c_{n}") for n in prevs],
            *[F.sum(f"_t_{n}").over(Window.partitionBy("_slot.key")).alias(f"_c_{n}") for n in totals],
        )
        return self.spark.createDataFrame(scan.toArrow(), scan.schema)


def _position(bounds: Column, at: Column) -> Column:
    """How many of the sorted ``bounds`` are not above ``at``, by halving."""
    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(bounds))))
    start = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = ((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(bounds, middle) <= at
        moved = F.when(below, F.struct((middle + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))
        return F.when(s["low"] < s["high"], moved).otherwise(s)

    return F.when(bounds.isNotNull(), F.aggregate(steps, start, halve, lambda s: s["low"]))


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    prevs: dict[str, Column] | None = None,
    like: DataFrame | None = None,
) -> DataFrame:
    """``df`` with running values over ``keys`` in ``order``; see ``Ordered``."""
    pieces = Ordered(df, keys, order, like)
    return pieces.running(pieces.rows, sums=sums, lasts=lasts, prevs=prevs).drop("_slot")


def ordered_text(pos: Column, text: Column, sep: str) -> Column:
    """Aggregate: texts joined in position order; null texts are left out. The result is one document cell."""
    items = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(pos.alias("p"), text.alias("t")))))
    return F.array_join(F.transform(items, lambda x: x["t"]), sep)
