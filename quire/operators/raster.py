"""Grey-scale page rasters: metrics per page and comparison of pairs.

A raster is one array cell in row-major order, so metrics are narrow folds with integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ink threshold, SSIM constants and gate.
DARK = 235
C1 = (0.01 * 255) ** 2
C2 = (0.03 * 255) ** 2
SSIM_GATE = 0.97


def _ratio(num: Column, den: Column) -> Column:
    return F.round(num.cast("decimal(20,8)") / den, 4).cast("double")


def page_metrics(rasters: DataFrame, width: int, *ids: str) -> DataFrame:
    """ids, dark_ratio, upper_dark, lower_dark, centroid_y of the ``pixels`` array."""
    dark = F.transform("pixels", lambda v, i: F.struct((v < DARK).cast("int").alias("d"), F.floor(i / width).cast("int").alias("y")))

    def total(f) -> Column:
        return F.aggregate("ink", F.lit(0), lambda acc, p: acc + f(p))

    base = rasters.select(*ids, F.size("pixels").alias("n"), dark.alias("ink"))
    rows = F.greatest(F.lit(1), F.ceil(F.col("n") / width).cast("int"))
    half = F.floor(rows / 2).cast("int")
    sums = base.select(
        *ids,
        "n",
        rows.alias("rows"),
        total(lambda p: p["d"]).alias("dark"),
        total(lambda p: F.when(p["y"] < half, p["d"]).otherwise(0)).alias("upper"),
        total(lambda p: p["d"] * p["y"]).alias("moment"),
    )
    pixels = F.greatest(F.lit(1), F.col("n"))
    half_pixels = F.greatest(F.lit(1), F.floor(F.col("n") / 2).cast("int"))
    centroid = F.col("moment").cast("decimal(20,8)") / F.col("dark") / F.greatest(F.lit(1), F.col("rows") - 1)
    return sums.select(
        *ids,
        _ratio(F.col("dark"), pixels).alias("dark_ratio"),
        _ratio(F.col("upper"), half_pixels).alias("upper_dark"),
        _ratio(F.col("dark") - F.col("upper"), half_pixels).alias("lower_dark"),
        F.when(F.col("dark") == 0, 0.0).otherwise(F.round(centroid, 4).cast("double")).alias("centroid_y"),
    )


def _moments(a: str, b: str) -> Column:
    """struct(n, x, y, xx, yy, xy): integer sums over two pixel arrays of equal length."""
    zero = F.struct(*[F.lit(0).cast("bigint").alias(k) for k in ("n", "x", "y", "xx", "yy", "xy", "ad")])
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y")))

    def step(acc: Column, p: Column) -> Column:
        return F.struct(
            (acc["n"] + 1).alias("n"),
            (acc["x"] + p["x"]).alias("x"),
            (acc["y"] + p["y"]).alias("y"),
            (acc["xx"] + p["x"] * p["x"]).alias("xx"),
            (acc["yy"] + p["y"] * p["y"]).alias("yy"),
            (acc["xy"] + p["x"] * p["y"]).alias("xy"),
            (acc["ad"] + F.abs(p["x"] - p["y"])).alias("ad"),
        )

    return F.aggregate(pairs, zero, step)


def compare(pairs: DataFrame, a: str, b: str, *ids: str) -> DataFrame:
    """ids, ssim, mad: global structural similarity (clamped to -1..1, 1 or 0 on a zero denominator) and mean absolute
    difference."""
    m = pairs.select(*ids, _moments(a, b).alias("m"))

    def v(k: str) -> Column:
        return F.col(f"m.{k}").cast("double")

    n = v("n")
    mx, my = v("x") / n, v("y") / n
    vx, vy = v("xx") / n - mx * mx, v("yy") / n - my * my
    cov = v("xy") / n - mx * my
    num = (2 * mx * my + C1) * (2 * cov + C2)
    den = (mx * mx + my * my + C1) * (vx + vy + C2)
    # greatest and least skip nulls, so a pair without a partner is kept null explicitly.
    ssim = F.when(den == 0, F.when(num == 0, 1.0).otherwise(0.0)).when(
        den.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), num / den))
    )
    return m.select(*ids, F.round(ssim, 6).alias("ssim"), F.round(v("ad") / n, 6).alias("mad"))


def paired_pages(actual: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """key, page, has_a, has_b, ssim, mad: pages paired by key and number; scores only where both are there."""
    a = actual.select(key, "page", F.col("pixels").alias("a"))
    b = baseline.select(key, "page", F.col("pixels").alias("b"))
    joined = a.join(b, [key, "page"], "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return compare(
        joined.select(
            key, "page", F.col("a").isNotNull().alias("has_a"), F.col("b").isNotNull().alias("has_b"),
            F.when(both, F.col("a")).alias("a"), F.when(both, F.col("b")).alias("b"),
        ),
        "a", "b", key, "page", "has_a", "has_b",
    )


def baseline_failures(actual: DataFrame, baseline: DataFrame, key: str, gate: float = SSIM_GATE) -> DataFrame:
    """key, page, ssim, reason: one row per page below the gate; page 0 stands for a key whose page counts differ, or that
    has no baseline page at all (then its only row)."""
    scored = paired_pages(actual, baseline, key)
    low = scored.filter(F.col("ssim") < gate).select(key, "page", "ssim", F.lit(f"ssim_below_threshold threshold={gate}").alias("reason"))
    g = scored.groupBy(key).agg(F.count_if("has_b").alias("expected"), F.count_if("has_a").alias("got"))
    mismatch = F.format_string("page_count_mismatch expected=%d actual=%d", "expected", "got")
    reason = F.when(F.col("expected") == 0, "baseline_missing").otherwise(mismatch)
    whole = g.filter(F.col("expected") != F.col("got"))
    return low.unionByName(whole.select(key, F.lit(0).cast(scored.schema["page"].dataType).alias("page"), F.lit(0.0).alias("ssim"), reason.alias("reason")))


def baseline_check(actual: DataFrame, baseline: DataFrame, key: str, gate: float = SSIM_GATE) -> DataFrame:
    """key, pages_expected, pages_actual, mean_ssim, failures, passed.

    Pages without a partner count as one page-count failure, a key without any baseline page as one missing-baseline
    failure; ``baseline_failures`` lists them.
    """
    scored = paired_pages(actual, baseline, key)
    g = scored.groupBy(key).agg(
        F.count_if("has_b").alias("pages_expected"),
        F.count_if("has_a").alias("pages_actual"),
        F.count_if(F.col("ssim") < gate).alias("low_pages"),
        (F.sum(F.col("ssim").cast("decimal(10,6)")) / F.count("ssim")).alias("mean"),
    )
    missing = F.col("pages_expected") == 0
    mismatch = F.col("pages_expected") != F.col("pages_actual")
    failures = F.when(missing, 1).otherwise(F.col("low_pages") + mismatch.cast("int"))
    return g.select(
        key,
        "pages_expected",
        "pages_actual",
        F.when(missing, 0.0).otherwise(F.coalesce(F.round("mean", 4).cast("double"), F.lit(0.0))).alias("mean_ssim"),
        failures.cast("bigint").alias("failures"),
        (failures == 0).alias("passed"),
    )


def _num(x: str) -> Column:
    return F.lit(x).cast("decimal(8,4)")


def expected_ink(lines: Column, capacity: Column, headings: Column, paragraphs: Column, lists: Column) -> tuple[Column, Column]:
    """Expected dark ratio and centroid of a page from its profile (exact decimals)."""
    fill = (lines.cast("decimal(12,4)") / F.greatest(F.lit(1), capacity)).cast("decimal(12,8)")
    use = F.least(F.lit("1").cast("decimal(12,8)"), fill)
    dark = _num("0.006") + use * _num("0.012") + headings * _num("0.0008") + lists * _num("0.0005")
    centre = _num("0.16") + headings * _num("0.015") + paragraphs * _num("0.006") + use * _num("0.08")
    # Narrow decimals: wide ones lose scale when multiplied.
    narrow = "decimal(16,12)"
    return F.least(_num("0.03"), dark.cast(narrow)), F.least(_num("0.45"), centre.cast(narrow))


def page_scores(actual: DataFrame, expected: DataFrame, min_page_score: float = 65.0) -> DataFrame:
    """actual: capacity, doc_id, page, dark_ratio, centroid_y; expected: page profiles with class threshold.

    A page without a profile is compared with a half-full empty one. The class threshold is shown, but the page gate
    never exceeds ``min_page_score``.
    """
    j = actual.join(expected, ["capacity", "doc_id", "page"], "left")
    found = F.col("blocks").isNotNull()
    n = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    lines = F.when(found, F.col("lines")).otherwise(F.floor(F.col("capacity") / 2))
    dark, centre = expected_ink(lines, F.col("capacity"), n("headings"), n("paragraphs"), n("lists"))
    d = F.abs(F.col("dark_ratio").cast("decimal(8,4)") - dark).cast("decimal(16,12)")
    c = F.abs(F.col("centroid_y").cast("decimal(8,4)") - centre).cast("decimal(16,12)")
    close = found & (d <= _num("0.005")) & (c <= _num("0.02"))
    raw = F.greatest(_num("0"), F.least(_num("100"), 100 - d * 2500 - c * 120))
    score = F.when(close, 100.0).otherwise(F.round(raw, 2).cast("double"))
    out = j.select(
        "capacity",
        "doc_id",
        "page",
        score.alias("score"),
        F.coalesce("threshold", F.lit(65.0)).alias("class_threshold"),
    )
    gate = F.least(F.col("class_threshold"), F.lit(min_page_score))
    return out.withColumn("failed", F.col("score") < gate)


def visual_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("capacity", "doc_id").agg(
        F.count("*").alias("pages"),
        F.count_if("failed").alias("failed_pages"),
        F.round(F.sum(F.col("score").cast("decimal(12,2)")) / F.count("*"), 2).cast("double").alias("average_score"),
    )
