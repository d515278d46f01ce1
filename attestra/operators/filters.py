"""Payload filters (must, should, must_not) compiled to one predicate, checked against the indexed fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _match(column: Column, match: dict, is_array: bool) -> Column:
    if "value" in match:
        return F.array_contains(column, match["value"]) if is_array else column == F.lit(match["value"])
    values = match["any"]
    return F.arrays_overlap(column, F.array(*map(F.lit, values))) if is_array else column.isin(values)


def _range(column: Column, bounds: dict) -> Column:
    ops = {"gte": column.__ge__, "lte": column.__le__, "gt": column.__gt__, "lt": column.__lt__}
    return reduce(Column.__and__, [ops[k](F.lit(v)) for k, v in bounds.items()])


def compiled(clause: dict, fields: dict[str, str]) -> Column:
    """fields: name -> kind of the indexed fields; a trailing [] marks arrays. Other keys raise ValueError. Null fields never match."""
    parts = [c for k in ("must", "should", "must_not") for c in clause.get(k, [])]
    unknown = sorted({c["key"] for c in parts} - set(fields))
    if unknown:
        raise ValueError(f"not indexed: {', '.join(unknown)}")

    def one(c: dict) -> Column:
        column = F.col(c["key"])
        test = _match(column, c["match"], fields[c["key"]].endswith("[]")) if "match" in c else _range(column, c["range"])
        return F.coalesce(test, F.lit(False))

    out = reduce(Column.__and__, map(one, clause.get("must", [])), F.lit(True))
    if clause.get("should"):
        out = out & reduce(Column.__or__, map(one, clause["should"]))
    if clause.get("must_not"):
        out = out & ~reduce(Column.__or__, map(one, clause["must_not"]))
    return out
