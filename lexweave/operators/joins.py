"""Joins in which one key may hold any part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task joins; keys with more are dealt to several.
ROWS_A_TASK = 1_000_000


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def key_counts(rows: DataFrame, key: str | list[str], *more) -> DataFrame:
    """(key, n, more...): rows of each key, combined before the shuffle; more are further aggregates."""
    return rows.dropna(subset=_keys(key)).groupBy(*_keys(key)).agg(F.count("*").alias("n"), *more)


def with_parts(rows: DataFrame, counts: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """rows with _parts, into how many parts the key of each falls by counts (key..., n): one for all but the keys of more
    than rows_a_task rows. These are at most rows / rows_a_task, and are broadcast."""
    on = [c for c in counts.columns if c != "n"]
    parts = F.broadcast(counts.filter(F.col("n") > rows_a_task).select(*on, F.ceil(F.col("n") / rows_a_task).alias("_parts")))
    return rows.join(parts, on, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("long")))


def dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with _salt, the part of its key that a row falls into by a hash of the columns by."""
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.col("_parts")))


def repeated(heads: DataFrame) -> DataFrame:
    """heads for each _salt of their _parts, which are dropped."""
    return heads.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")


def split_join(rows: DataFrame, heads: DataFrame, key: str | list[str], by: list[str], how: str = "inner", counts: DataFrame | None = None, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """rows joined with heads, which has few rows of a key, on key, where a key with many rows is dealt by a hash of the
    columns by to as many tasks as its size asks for. counts (key, or some columns of it, and n) are made here if not
    given. With how 'left', rows without a key are dealt to all tasks."""
    on = _keys(key)
    counts = key_counts(rows.select(*on), on) if counts is None else counts
    counts = counts.select(*[c for c in on if c in counts.columns], "n")
    missing = F.greatest(*[F.col(c).isNull() for c in on]) if len(on) > 1 else F.col(on[0]).isNull()
    placed = dealt(with_parts(rows, counts, rows_a_task), by)
    placed = placed.withColumn("_salt", F.when(missing, F.xxhash64(*by)).otherwise(F.col("_salt"))).drop("_parts")
    return placed.join(repeated(with_parts(heads, counts, rows_a_task)), [*on, "_salt"], how).drop("_salt")
