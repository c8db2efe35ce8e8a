"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name


def session_id_from_path(path: Column) -> Column:
    """The directory before the first ``subagents`` component, else the file's stem."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "subagents")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.when(at > 1, F.try_element_at(parts, (at - 1).cast("int"))).otherwise(stem)


def instant(timestamp: Column) -> Column:
    """ISO 8601 text as a timestamp, null if it isn't one."""
    return F.try_to_timestamp(timestamp)


def has_text(column: Column, part: str) -> Column:
    """A literal substring, without regard to the case."""
    return F.contains(F.lower(column), F.lit(part.lower()))


def cut(column: Column, most: int, mark: str = "") -> Column:
    """At most so many characters, with a mark if some are missing."""
    return F.when(F.length(column) > most, F.concat(F.substring(column, 1, most), F.lit(mark))).otherwise(column)


def json_type(variant: Column, path: str) -> Column:
    """STRING, BOOLEAN, ARRAY<...> ... of what is at ``path``."""
    return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))


def _one(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    n = free_name(df.columns, "n")
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(n) == 1).drop(n)


def upsert_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in ``order`` wins."""
    return _one(df, keys, order)


def upsert_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last in ``order`` wins."""
    return _one(df, keys, [F.desc(c) for c in order])


def beside(df: DataFrame, figures: DataFrame) -> DataFrame:
    """``df`` with the one row of figures of an aggregate over a whole table at each row."""
    one = figures.groupBy().agg(*[F.first(c).alias(c) for c in figures.columns])  # one row, whatever is given
    return df.crossJoin(F.broadcast(one))


def newest(df: DataFrame, limit: int | None, *order) -> DataFrame:
    """Sorted, and cut if there is a limit."""
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)
