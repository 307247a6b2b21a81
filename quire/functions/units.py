"""Measurement helpers (exact decimals, half-up unless stated)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# EMU per unit; twentieths of a point per inch and point; half-points per point.
EMU = {"pt": 12700, "in": 914400, "cm": 360000, "mm": 36000, "emu": 1}
DXA_PER_INCH, TWIPS_PER_POINT, HALF_POINTS = 1440, 20, 2
_WIDE = "decimal(30,10)"


def to_emu(value: Column, unit: Column) -> Column:
    """Whole EMU of a measure; null for an unknown unit."""
    u = F.lower(F.trim(unit))
    factor = F.when(u == "pt", EMU["pt"])
    for name in ("in", "cm", "mm", "emu"):
        factor = factor.when(u == name, EMU[name])
    return F.round(value.cast(_WIDE) * factor.cast("decimal(8,0)"), 0).cast("bigint")


def emu_to_pt(emu: Column) -> Column:
    return F.round(emu.cast(_WIDE) / EMU["pt"], 4).cast("decimal(18,4)")


def _scaled(value: Column, by: int) -> Column:
    """value / by as a float, 0.0 when it is no number."""
    return F.coalesce(value.try_cast("double") / F.lit(float(by)), F.lit(0.0))


def dxa_to_inches(value: Column) -> Column:
    return _scaled(value, DXA_PER_INCH)


def halfpt_to_pt(value: Column) -> Column:
    return _scaled(value, HALF_POINTS)


def twips_to_pt(value: Column) -> Column:
    return _scaled(value, TWIPS_PER_POINT)


def inches_text(dxa: Column) -> Column:
    """Inches with two decimals and an inch mark, from twentieths of a point."""
    cents = F.floor((F.abs(dxa) * 100 + DXA_PER_INCH // 2) / DXA_PER_INCH).cast("bigint")
    whole = F.floor(cents / 100).cast("bigint").cast("string")
    sign = F.when((dxa < 0) & (cents > 0), "-").otherwise("")
    return F.concat(sign, whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit('"'))


def points_text(halfpt: Column) -> Column:
    half = F.when(halfpt % 2 == 0, ".0pt").otherwise(".5pt")
    return F.concat(F.floor(halfpt / 2).cast("bigint").cast("string"), half)
