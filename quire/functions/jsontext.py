"""Strict JSON tests: the built-in parsers read the first value and ignore what follows it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_json(text: Column) -> Column:
    """True only when the whole text is one JSON value.

    Text after the first value would have to close both an array and an object to pass both wrapped forms.
    """
    as_item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_field = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}")))
    one = F.size(F.try_variant_get(as_item, "$", "array<variant>")) == 1
    return F.coalesce(F.try_parse_json(text).isNotNull() & as_field.isNotNull() & one, F.lit(False))
