"""Row filters. Each is a predicate the optimizer can push to the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import n_fields, strict_date, strict_int


def above(df: DataFrame, number: Column, threshold: float) -> DataFrame:
    """Strictly greater; null (also: unparseable) is dropped."""
    return df.where(number > threshold)


def text_above(df: DataFrame, text: str, threshold: int) -> DataFrame:
    """Text that holds an integer above the threshold; other text is dropped."""
    return above(df, strict_int(F.col(text)), threshold)


def before(df: DataFrame, text: str, cutoff: str) -> DataFrame:
    """Text dates strictly before the cutoff. Text that is no ``yyyy-MM-dd`` date, null
    included, is kept: it counts as earlier than any cutoff."""
    return df.where(F.coalesce(strict_date(F.col(text)) < F.lit(cutoff).cast("date"), F.lit(True)))


def starts_with(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(F.col(column).startswith(prefix))


def in_list(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose value is listed, once each however often the list repeats it."""
    return df.where(F.col(column).isin(list(dict.fromkeys(values))))


def well_formed(df: DataFrame, text: str, arity: int, separator: str = ",") -> DataFrame:
    return df.where(n_fields(F.col(text), separator) == arity)
