"""Canonical spellings of entity keys and the surviving version of re-delivered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANKS = " \t\r\n "


def _none_if_empty(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def patient_key(c: Column) -> Column:
    """Lower case without blanks, tabs, '-' and '_'; an empty result is null."""
    return _none_if_empty(F.lower(F.translate(c, _BLANKS + "-_", "")))


def file_key(c: Column) -> Column:
    """Lower-case base name without surrounding blanks; an empty result is null."""
    return _none_if_empty(F.lower(F.btrim(F.regexp_replace(c, r"^.*[/\\]", ""), F.lit(_BLANKS))))


def latest_version(df: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """One row per key: the columns of the row with the latest time.

    Only `columns` travel. Versions with the same time are ordered by their
    values, so the outcome doesn't depend on the order of arrival; a null time is
    the oldest. Rows with a null key are versions of nothing and all stay.
    """
    # Maps can't be ordered; callers pass plain columns.
    value = F.struct(*[F.col(c) for c in columns])
    keyed = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(F.struct(F.col(time).alias("t"), value.alias("v"))).alias("m"))
        .select(key, *[F.col(f"m.v.{c}").alias(c) for c in columns])
    )
    loose = df.where(F.col(key).isNull()).select(key, *columns)
    return keyed.unionAll(loose)
