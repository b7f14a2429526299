"""Ad-hoc conditions on a view's rows, evaluated on what the cells show: text, trimmed, letter case aside; NULL shows as nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("contains", "not_contains", "equals", "not_equals", "starts_with", "ends_with", "in", "not_in", "is_empty", "is_not_empty", "<", "<=", ">", ">=")
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: str = ""


def shown(name: str) -> Column:
    return F.coalesce(F.trim(F.col(f"`{name}`").cast("string")), F.lit(""))


def _equals(name: str, value: str, numeric: bool) -> Column:
    text = F.lower(shown(name)) == value.strip().lower()
    if not numeric:
        return text
    try:
        wanted = F.lit(float(value))
    except ValueError:
        return text
    cell = shown(name).try_cast("double")
    return F.when(cell.isNotNull(), cell == wanted).otherwise(text)


def compiled(of: Condition, numeric: bool) -> Column | None:
    """The condition as a Column; None if it needs a value and has none."""
    if of.operator not in OPERATORS:
        raise ValueError(f"unknown operator {of.operator}")
    cell, value = F.lower(shown(of.column)), of.value.strip().lower()
    if of.operator == "is_empty":
        return cell == ""
    if of.operator == "is_not_empty":
        return cell != ""
    if not value:
        return None
    if of.operator in ("in", "not_in"):
        found = F.lit(False)
        for v in filter(None, (x.strip() for x in value.split(","))):
            found = found | _equals(of.column, v, numeric)
        return found if of.operator == "in" else ~found
    if of.operator in ("<", "<=", ">", ">="):
        number, wanted = shown(of.column).try_cast("double"), F.lit(value).try_cast("double")
        return F.coalesce({"<": number < wanted, "<=": number <= wanted, ">": number > wanted, ">=": number >= wanted}[of.operator], F.lit(False))
    return {
        "contains": lambda: cell.contains(value),
        "not_contains": lambda: ~cell.contains(value),
        "equals": lambda: _equals(of.column, of.value, numeric),
        "not_equals": lambda: ~_equals(of.column, of.value, numeric),
        "starts_with": lambda: cell.startswith(value),
        "ends_with": lambda: cell.endswith(value),
    }[of.operator]()


def row_filter(rows: DataFrame, conditions: list[Condition], match_all: bool = True, search: str = "") -> DataFrame:
    """The rows that meet all (or any) of the conditions and hold every search word in some column that isn't a number.

    Conditions on unknown columns or without a needed value are left out; with nothing left all rows stay."""
    numeric = {n for n, k in rows.dtypes if k in _NUMBERS or k.startswith("decimal")}
    made = [x for of in conditions if of.column in rows.columns and (x := compiled(of, of.column in numeric)) is not None]
    out = rows
    if made:
        whole = made[0]
        for x in made[1:]:
            whole = whole & x if match_all else whole | x
        out = out.where(whole)
    texts = [n for n, k in rows.dtypes if n not in numeric and not k.startswith(("array", "struct", "map"))]
    for word in search.lower().split():
        found = F.lit(False)
        for n in texts:
            found = found | F.lower(shown(n)).contains(word)
        out = out.where(found)
    return out


def sort_by(rows: DataFrame, column: str, descending: bool = False, tie: str = "row_id") -> DataFrame:
    """By what a column shows: numbers by value with others last, texts by their bytes; descending is the exact reverse. Equal rows keep the order of tie."""
    numeric = dict(rows.dtypes)[column] in _NUMBERS
    key = shown(column).try_cast("double") if numeric else shown(column)
    return rows.orderBy(key.desc_nulls_first() if descending else key.asc_nulls_last(), *([tie] if tie in rows.columns else []))
