"""Short number text for tiles and notes."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_number(value: Column, thousands_from: float = 10_000, whole_from: float | None = 100) -> Column:
    """1.23M above a million, 12.3K above `thousands_from`, plain below.

    Tiles shorten from ten thousand and drop decimals from one hundred; fact text
    shortens from one thousand and always keeps two decimals (`whole_from=None`).
    """
    size = F.abs(value)
    text = F.when(size >= 1_000_000, F.concat(F.format_number(value / 1_000_000, 2), F.lit("M"))).when(
        size >= thousands_from, F.concat(F.format_number(value / 1_000, 1), F.lit("K"))
    )
    if whole_from is not None:
        text = text.when(size >= whole_from, F.format_number(value, 0))
    return text.otherwise(F.format_number(value, 2))
