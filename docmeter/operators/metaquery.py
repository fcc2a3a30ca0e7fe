"""Structured queries over listed tables and fields."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
ROWS, MOST_ROWS = 20, 100


class QueryError(ValueError):
    """A query that asks for something which is not listed."""


@dataclass(frozen=True)
class Listed:
    """A table with the fields that may be read, and those that may be summed."""

    rows: DataFrame
    fields: list[str]
    numeric: list[str] = field(default_factory=list)
    owner: str = "owner_id"


def condition(name: str, op: str, value: object) -> Column:
    """The eight comparisons."""
    c = F.col(name)
    match op:
        case "eq":
            return c == value
        case "ne":
            return c != value
        case "gt":
            return c > value
        case "ge":
            return c >= value
        case "lt":
            return c < value
        case "le":
            return c <= value
        case "in":
            return c.isin(value if isinstance(value, list) else [value])
        case "contains":
            return F.contains(c.cast("string"), F.lit(str(value)))
    raise QueryError(f"no comparison {op}")


def clamped(value: object, default: int = ROWS, most: int = MOST_ROWS) -> int:
    """T4: a row count; what is no number is the default, the rest is brought into 1 to `most`."""
    try:
        return max(1, min(int(value), most))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default


def run(spec: dict, tables: dict[str, Listed], owner: object) -> DataFrame:
    """A checked query of one owner's rows. What is not listed is an error, never a guess."""
    listed = tables.get(spec.get("table", ""))
    if listed is None:
        raise QueryError(f"tables: {sorted(tables)}")
    names = [*(spec.get("fields") or listed.fields), *(f.get("field") for f in spec.get("filters") or []), *(spec.get("group_by") or [])]
    order, total = spec.get("order_by"), spec.get("aggregate")
    names += [order.get("field")] if order else []
    if unknown := [n for n in names if n not in listed.fields]:
        raise QueryError(f"fields that are not listed: {unknown}")
    rows = listed.rows.where(F.col(listed.owner) == owner)
    for f in spec.get("filters") or []:
        rows = rows.where(condition(f["field"], f.get("op", "eq"), f.get("value")))
    direction = lambda o: F.col(o["field"]).desc() if o.get("desc") else F.col(o["field"]).asc()
    n = clamped(spec.get("limit"))
    if total is None:
        out = rows.select(*(spec.get("fields") or listed.fields))
        return (rows.orderBy(direction(order)).select(*out.columns) if order else out).limit(n)
    fn, of = total.get("fn"), total.get("field")
    if fn not in AGGREGATES or (fn != "count" and of not in listed.numeric):
        raise QueryError(f"no aggregate {fn} of {of}")
    label = "count" if fn == "count" else f"{fn}_{of}"
    by = spec.get("group_by") or []
    out = rows.groupBy(*by).agg((F.count("*") if fn == "count" else AGGREGATES[fn](of)).alias(label))
    if order and order["field"] not in by:
        raise QueryError("groups are ordered by their own fields")
    return out.orderBy(direction(order) if order else F.col(label).desc(), *by).limit(n)


def page(rows: DataFrame, offset: int, limit: int, at: str = "created_at", key: str = "id") -> DataFrame:
    """One page in a total order; a page out of range is an error."""
    if offset < 0 or not 1 <= limit <= MOST_ROWS:
        raise QueryError(f"offset {offset}, limit {limit}")
    return rows.orderBy(F.col(at).desc(), F.col(key).desc()).offset(offset).limit(limit)
