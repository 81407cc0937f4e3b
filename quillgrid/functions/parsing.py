"""Column expressions that read numbers, moments and booleans out of text.

Everything here stays inside whole-stage codegen: no Python runs per row.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: tokens and marks that decide how text is read -------------
BOOLEAN_TOKENS = {
    "true": True, "false": False, "yes": True, "no": False, "y": True,
    "n": False, "t": True, "f": False, "1": True, "0": False,
}
NUMBER_MARKS = "$€£₹¥,"
SPACES = " \t\n\r\f\v                 　"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
LONGEST_DATE = 60
MISSING_LABEL = "(missing)"
# -----------------------------------------------------------------------------

_NUMBER = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)%?$"
# Spellings of days. Each pattern is anchored, so a cell that is no date fails at its first letters.
_REST = r"([ T][0-9].*)?$"
_PLAIN_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9:.]+)?$"
_YEAR_DASHED = r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2}" + _REST[:-1] + r")?$"
_YEAR_SLASHED = r"^([0-9]{4})[./]([0-9]{1,2})[./]([0-9]{1,2})" + _REST
_DAYS = r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]"
_YEAR_LAST = _DAYS + "([0-9]{4})" + _REST
#: Two digits up to 68 are of this century.
_RECENT, _LAST = "([0-5][0-9]|6[0-8])", "(69|[7-9][0-9])"
_ORDINAL, _YEAR, _DAY, _NAME = "(?:st|nd|rd|th)?", "([0-9]{4}|[0-9]{2})", "([0-9]{1,2})", r"([a-z]{3,9})\.?"
# Groups: name, day, year | day, name, year | name, year | year, name, day; then the time.
_NAMED = (
    rf"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? +)?(?:{_NAME}[ -]{_DAY}{_ORDINAL},?[ -]{_YEAR}|{_DAY}{_ORDINAL}[ -]{_NAME},?[ -]{_YEAR}"
    rf"|{_NAME},?[ -]([0-9]{{4}})|([0-9]{{4}})[ -]{_NAME}[ -]{_DAY})((?:,? [0-9].*)?)$"
)
_NAMED_ORDER = "$3$6$8$9-$1$5$7$10-$2$4$11$12"
#: How any spelling but the plain one begins.
_BEGINNING = r"^ *(?:[0-9]{1,4}(?:st|nd|rd|th|ST|ND|RD|TH)?[ ./-][0-9A-Za-z]|[A-Za-z]{3,9}[., ])"
_HALF_DAY = r"[0-9] ?[aApP]\.?[mM]\.?$"
_CLOCK = r"(?i),?[ T]+([0-9]{1,2})(?::([0-9]{2}))?(?::([0-9]{2}(?:\.[0-9]{1,6})?))? ?([ap])\.?m\.?$"


def strip_marks(text: Column, decimal_comma: bool = False) -> Column:
    """Drop currency signs, separators, spaces and one trailing percent sign."""
    if decimal_comma:
        text = F.translate(text, ",.", ".")  # "." maps to nothing, "," to "."
    return F.regexp_replace(F.translate(text, NUMBER_MARKS + SPACES, ""), "%$", "")


def text_to_number(text: Column, decimal_comma: bool = False) -> Column:
    if decimal_comma:
        text = F.translate(text, ",.", ".")
    bare = F.translate(text, NUMBER_MARKS + SPACES, "")
    # One pattern drops a trailing percent sign and keeps out spellings that only the
    # JVM accepts ("1d", "0x1p3"); a mismatch gives "", which casts to null. Text without
    # any digit, the common case of a category, is passed over cheaply.
    return F.when(text.rlike("[0-9]"), F.regexp_extract(bare, _NUMBER, 1).try_cast("double"))


def _named_day(text: Column) -> Column:
    """Month names become numbers, a missing day the first, two digits a year; whatever is left over reads as no date."""
    found = F.lower(F.regexp_replace(text, _NAMED, _NAMED_ORDER))
    for number, month in enumerate(MONTHS, 1):
        for name in (month, *(["sept"] if number == 9 else []), month[:3]):
            found = F.replace(found, F.lit(f"-{name}-"), F.lit(f"-{number}-"))
    found = F.replace(F.regexp_replace(found, "-$", "-1"), F.lit(","), F.lit(""))
    found = F.regexp_replace(F.regexp_replace(found, f"^{_RECENT}-", "20$1-"), f"^{_LAST}-", "19$1-")
    return found.try_cast("timestamp_ntz")


def _day_and_time(t: Column) -> Column:
    """Moments of the spellings without am and pm. The text is used as seldom as can be: it may be a long expression."""

    def rewritten(pattern: str, order: str) -> Column:
        return F.regexp_replace(t, pattern, order).try_cast("timestamp_ntz")

    def year_last(year: str, century: str) -> tuple[Column, Column]:
        pattern = _DAYS + year + _REST
        return t.rlike(pattern), F.coalesce(*[rewritten(pattern, f"{century}$3-{order}$4") for order in ("$1-$2", "$2-$1")])

    return (
        F.when(t.rlike(_YEAR_DASHED), t.try_cast("timestamp_ntz"))
        .when(t.rlike(_YEAR_SLASHED), rewritten(_YEAR_SLASHED, "$1-$2-$3$4"))
        .when(*year_last("([0-9]{4})", ""))
        .when(*year_last(_RECENT, "20"))
        .when(*year_last(_LAST, "19"))
        .when(t.rlike(_NAMED), _named_day(t))
    )


def _half_day(text: Column) -> Column:
    """The time since midnight of a spelling with am or pm; null where there is no such time."""
    hour, minute, second, half = (F.regexp_extract(text, _CLOCK, i) for i in range(1, 5))
    afternoon = F.when(F.lower(half) == "p", 12).otherwise(0)
    # Twelve is the hour zero; a text of 0 or beyond 12 or 59 is no time.
    hour = F.when(hour.rlike("^(0?[1-9]|1[0-2])$"), hour.try_cast("int") % 12 + afternoon)
    minute = F.when(minute.rlike("^([0-5][0-9])?$"), F.concat(F.lit("0"), minute).try_cast("int"))
    second = F.when(second.rlike("^([0-5][0-9].*)?$"), F.concat(F.lit("0"), second).try_cast("decimal(8,6)"))
    return F.make_dt_interval(F.lit(0), hour, minute, second)


def text_to_moment(text: Column) -> Column:
    """Read mixed date spellings; month comes first where day and month are ambiguous."""
    t = F.trim(text)
    clock = F.when(t.rlike(_HALF_DAY), _half_day(t)).otherwise(F.make_dt_interval())
    # The common spelling is tried first; text that begins otherwise, has no two digits in a
    # row, or is longer than any date, is passed over.
    return F.when(text.rlike(_PLAIN_DATE), text.try_cast("timestamp_ntz")).when(
        F.length(text).between(6, LONGEST_DATE) & text.rlike(_BEGINNING) & text.rlike("[0-9]{2}"), _day_and_time(F.regexp_replace(t, _CLOCK, "")) + clock
    )


def text_to_boolean(text: Column) -> Column:
    token = F.lower(F.trim(text))
    true = [k for k, v in BOOLEAN_TOKENS.items() if v]
    false = [k for k, v in BOOLEAN_TOKENS.items() if not v]
    return F.when(token.isin(true), F.lit(True)).when(token.isin(false), F.lit(False))


# --- Typed access to one column of a frame -----------------------------------


def kind_of(dtype: T.DataType) -> str:
    """numeric, boolean, datetime or text, from the stored type."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "text"


def column(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(frame: DataFrame, name: str) -> Column:
    """The stored column with floating NaN read as missing."""
    c = column(name)
    if isinstance(frame.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def number_of(frame: DataFrame, name: str) -> Column:
    """The column as a number: stored numbers untouched, text parsed, dates missing."""
    kind = kind_of(frame.schema[name].dataType)
    if kind == "numeric":
        return present(frame, name)
    if kind == "boolean":
        return column(name).cast("int")
    if kind == "datetime":
        return F.lit(None).cast("double")
    return text_to_number(column(name).cast("string"))


def moment_of(frame: DataFrame, name: str) -> Column:
    """The column as a timezone-free timestamp."""
    kind = kind_of(frame.schema[name].dataType)
    if kind == "datetime":
        if isinstance(frame.schema[name].dataType, T.TimestampNTZType):
            return column(name)
        return column(name).cast("timestamp_ntz")
    if kind == "text":
        return text_to_moment(column(name).cast("string"))
    return F.lit(None).cast("timestamp_ntz")


def text_of(frame: DataFrame, name: str) -> Column:
    """The column as display text; numbers are written out without an exponent, midnights as dates."""
    c, dtype = present(frame, name), frame.schema[name].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.when(c == F.date_trunc("day", c), c.cast("date").cast("string")).otherwise(c.cast("string"))
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    text = c.cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        size = F.abs(c)
        plain = F.rtrim(text.try_cast("decimal(38,19)").cast("string"), F.lit("0"))
        plain = F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)
        wide = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
        return F.when(wide, plain).otherwise(text)
    return text


def label_of(frame: DataFrame, name: str) -> Column:
    """Group label: display text, with missing values as a group of their own."""
    return F.coalesce(text_of(frame, name), F.lit(MISSING_LABEL))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True)) if conditions else F.lit(True)
