"""Plan filters as predicates shaped so that the file scan can apply them."""

import datetime as dt
import re
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.errors import PlanError
from quillgrid.functions.parsing import all_of, column, kind_of, moment_of, number_of, text_of
from quillgrid.plans.model import Filter

_FLOATS = (T.FloatType, T.DoubleType)


def _reads_as_number(value: Any) -> bool:
    try:
        float(value)
    except (TypeError, ValueError):
        return False
    return True


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float))


def _moment(value: Any) -> Column:
    try:
        stamp = pd.Timestamp(value)
    except (TypeError, ValueError) as problem:
        raise PlanError(f"not a date: {value!r}") from problem
    return F.lit(stamp.isoformat(sep=" ")).cast("timestamp_ntz")


def _operands(frame: DataFrame, f: Filter, values: list) -> tuple[Column, list[Column]]:
    """Both sides of a comparison in one type: moments for dates, numbers otherwise."""
    kind = kind_of(frame.schema[f.column].dataType)
    as_dates = kind == "datetime" or any(
        isinstance(v, str) and not _reads_as_number(v) for v in values
    )
    if as_dates:
        return moment_of(frame, f.column), [_moment(v) for v in values]
    numbers = [v if _is_number(v) else float(v) for v in values]
    if kind == "numeric":
        whole = isinstance(frame.schema[f.column].dataType, T.IntegralType)
        literals = [int(n) if whole and float(n).is_integer() else n for n in numbers]
        return column(f.column), [F.lit(n) for n in literals]
    return number_of(frame, f.column), [F.lit(float(n)) for n in numbers]


def _not_nan(frame: DataFrame, name: str, test: Column) -> Column:
    """NaN sorts above every number in Spark, so upper-open tests must exclude it."""
    if isinstance(frame.schema[name].dataType, _FLOATS):
        return test & ~F.isnan(column(name))
    return test


def _text_equals(frame: DataFrame, name: str, values: list[str]) -> Column:
    """Equality on display text, turned into a typed test where that is the same."""
    dtype = frame.schema[name].dataType
    if isinstance(dtype, T.IntegralType):
        same = [int(v) for v in values if re.fullmatch(r"0|-?[1-9][0-9]*", v)]
        return column(name).isin(same) if same else column(name).isNull() & F.lit(False)
    if isinstance(dtype, T.DoubleType):
        same = [float(v) for v in values if _reads_as_number(v) and repr(float(v)) == v]
        return column(name).isin(same) if same else column(name).isNull() & F.lit(False)
    return text_of(frame, name).isin(values)


def _same_moment(frame: DataFrame, name: str, value: Any) -> Column:
    """Equality on a stored date or moment; a plain date stands for its whole day. Text that is no date equals nothing."""
    c, dtype = column(name), frame.schema[name].dataType
    never = c.isNull() & F.lit(False)
    try:
        stamp = pd.Timestamp(value)
    except (TypeError, ValueError):
        return never
    if _is_number(value) or stamp is pd.NaT:
        return never
    if isinstance(dtype, T.DateType):
        return c == F.lit(stamp.date()) if stamp == stamp.normalize() else never

    def moment(at: pd.Timestamp) -> Column:
        return F.lit(at.isoformat(sep=" ")).cast(dtype)

    day = isinstance(value, dt.date) and not isinstance(value, dt.datetime)
    if day or (isinstance(value, str) and ":" not in value):
        return (c >= moment(stamp)) & (c < moment(stamp + pd.Timedelta(days=1)))
    return c == moment(stamp)


def predicate(frame: DataFrame, f: Filter) -> Column:
    kind = kind_of(frame.schema[f.column].dataType)
    if kind == "datetime" and f.op in ("eq", "ne", "in"):
        values = f.value if f.op == "in" and isinstance(f.value, (list, tuple)) else [f.value]
        never = column(f.column).isNull() & F.lit(False)
        same = reduce(lambda a, b: a | b, [_same_moment(frame, f.column, v) for v in values], never)
        return ~same & column(f.column).isNotNull() if f.op == "ne" else same
    if f.op in ("eq", "ne"):
        if _is_number(f.value):
            c, (v,) = _operands(frame, f, [f.value])
            if f.op == "eq":
                return c == v
            # Stored numbers differ from anything when missing; parsed text does not.
            return (c != v) | column(f.column).isNull() if kind == "numeric" else c != v
        if f.op == "eq":
            return _text_equals(frame, f.column, [str(f.value)])
        return text_of(frame, f.column) != F.lit(str(f.value))
    if f.op == "in":
        values = f.value if isinstance(f.value, (list, tuple)) else [f.value]
        return _text_equals(frame, f.column, [str(v) for v in values])
    if f.op == "contains":
        text = text_of(frame, f.column)
        if f.literal:
            return F.contains(F.lower(text), F.lit(str(f.value).lower()))
        return text.rlike("(?i)" + str(f.value))
    if f.op == "between":
        c, (low, high) = _operands(frame, f, list(f.value))
        return (c >= low) & (c <= high)
    c, (v,) = _operands(frame, f, [f.value])
    tests = {"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}
    test = tests[f.op]
    return _not_nan(frame, f.column, test) if f.op in ("gt", "gte") and kind == "numeric" else test


def apply_filters(frame: DataFrame, filters) -> DataFrame:
    return frame.where(all_of([predicate(frame, f) for f in filters])) if filters else frame
