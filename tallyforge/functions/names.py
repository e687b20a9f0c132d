"""Name parsing expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def api_list(api: Column) -> Column:
    """A JSON value that is null, one name or a list of names, as an array."""
    listed = F.from_json(api, "array<string>")
    return F.when(api.isNull(), F.array().cast("array<string>")) \
        .when(F.startswith(F.ltrim(api), F.lit("[")), listed).otherwise(F.array(api))


def trailing_number(key: Column) -> Column:
    """Number behind the last underscore: decimal, else hexadecimal (with or without 0x), else 0."""
    tail = F.element_at(F.split(key, "_"), -1)
    digits = F.regexp_extract(tail, "^(?:0[xX])?([0-9a-fA-F]+)$", 1)
    hexed = F.when(digits != "", F.conv(digits, 16, 10).try_cast("long"))
    return F.coalesce(F.when(tail.rlike("^[0-9]+$"), tail.try_cast("long")), hexed, F.lit(0).cast("long"))
