"""Near-duplicate vectors by int8 tile products with error bounds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import forest, saved
from quire.llm.graph import components

COSINE, TILE, BLOCK = 0.9, 4096, 1024
#: Products of this many int8 pairs are exact in single precision: 1024 * 127 * 127 < 2 ** 24.
EXACT = 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors in double precision, their int8 codes and scales, and a bound on each one's quantisation error.

    The error's length is computed from the codes themselves, so it holds for every vector whatever its values.
    """
    top = np.abs(x).max(axis=1, keepdims=True)
    unit = x / top
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return unit, codes, scale, error


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of two int8 matrices."""
    out = a[:, :EXACT].astype("f4") @ b[:, :EXACT].astype("f4").T
    for k in range(EXACT, a.shape[1], EXACT):
        out = out.astype("f8") + a[:, k : k + EXACT].astype("f4") @ b[:, k : k + EXACT].astype("f4").T
    return out


def tile_pairs(x: np.ndarray, y: np.ndarray, least: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with cosine of x[i] and y[j] at least ``least``, in double precision.

    For unit vectors u = s q + e and v = t p + f: u.v = s t q.p + e.v + s q.f, so the int8 product is off by at most
    |e| + (1 + |e|) |f|. Only pairs that could reach the threshold within that are computed again.
    """
    u, q, s, e = quantised(x)
    v, p, t, f = quantised(y)
    left, right = [], []
    for a in range(0, len(x), BLOCK):
        for b in range(0, len(y), BLOCK):
            near = products(q[a : a + BLOCK], p[b : b + BLOCK])
            near *= s[a : a + BLOCK, None].astype(near.dtype)
            near *= t[b : b + BLOCK].astype(near.dtype)
            # per row of the tile, the loosest bound over its columns, and room for the two scalings
            room = e[a : a + BLOCK] + (1 + e[a : a + BLOCK]) * f[b : b + BLOCK].max() + 1e-5
            i, j = np.nonzero(near >= (least - room)[:, None].astype(near.dtype))
            for c in range(0, len(i), 1 << 18):
                m, n = i[c : c + (1 << 18)] + a, j[c : c + (1 << 18)] + b
                real = np.einsum("ij,ij->i", u[m], v[n]) >= least
                left.append(m[real])
                right.append(n[real])
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def linked(vectors: DataFrame, least: float = COSINE, tile: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    All vectors are compared whatever their labels. Vectors that are null, zero or hold null or non-finite components link
    with nothing, nor do vectors of different length. Equal vectors are compared once and weighted by their number, so a
    large group of copies is one row. The distinct vectors are dealt into parts; every pair of parts is a tile of at most
    about twice ``tile`` rows, in a task of its own. A tile returns, for each vector with a partner in it, how many, and one
    link to the smallest vector it reaches there. The comparison is complete, so its work grows with the square of the
    distinct vectors, at one int8 product a pair. Repeated vec_ids count as other vectors; an empty table gives no rows.
    """
    vector = F.col("embedding")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(vector.isNotNull() & ~bad, vector).alias("_v"))
    distinct = rows.where("_v is not null and vec_id is not null").groupBy("_v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    distinct = saved(distinct.select("id", "copies", "_v"), "vectors")
    parts = max(1, math.ceil(distinct.count() / tile))
    own = F.pmod(F.xxhash64("id"), F.lit(parts))
    dealt = distinct.select("*", own.alias("own"), F.size("_v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("other"))
    dealt = dealt.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, copies, part = (np.asarray(table[c]) for c in ("id", "copies", "own"))
        x = np.asarray(table["_v"].combine_chunks().flatten()).astype("f8").reshape(len(ids), -1)
        first, second = np.flatnonzero(part == table["a"][0].as_py()), np.flatnonzero(part == table["b"][0].as_py())
        same = table["a"][0].as_py() == table["b"][0].as_py()
        links = np.zeros(len(ids), np.int64)
        i, j = tile_pairs(x[first], x[second], least) if len(first) and len(second) else (first[:0], second[:0])
        i, j = first[i], second[j]
        if same:
            i, j = i[i < j], j[i < j]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        head = forest(len(ids), i, j)
        has = np.flatnonzero(links)
        return pa.table({"id": ids[has], "links": links[has], "head": ids[head[has]]})

    found = saved(dealt.groupBy("dim", "a", "b").applyInArrow(link, "id long, links long, head long"), "tile-links")
    groups = components(found.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = distinct.select("id", "copies", F.col("_v").alias("_w")).join(counts, "id", "left").join(groups, "id", "left")
    known = known.select("_w", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(known, rows["_v"] == known["_w"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
