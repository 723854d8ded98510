"""Duplicate rows, duplicate entities and rejected rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillhouse.operators.skew import HOT_ROWS, hottest, spread_join


def dedupe_by_key(df: DataFrame, key: str) -> DataFrame:
    """One row per primary key: the first by all other columns, nulls first.

    The least struct per key is an ordinary aggregate, so copies collapse before the
    shuffle and a key with very many copies sends one row per input task.
    """
    others = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.min(F.struct(*others)).alias("_first"))
        .select(*[F.col(c) if c == key else F.col(f"_first.{c}").alias(c) for c in df.columns])
    )


def _present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def survivors(
    df: DataFrame, natural_key: Sequence[str], id_column: str, attributes: Sequence[str] = ()
) -> DataFrame:
    """The row with the lowest id of each natural key, with that row's own attributes.

    The id leads the struct, so the least struct is the survivor's row: one aggregation
    in place of a minimum and a join back. Rows whose natural key is null are one group.
    """
    return (
        df.filter(F.col(id_column).isNotNull())
        .groupBy(*natural_key)
        .agg(F.min(F.struct(id_column, *attributes)).alias("_survivor"))
        .select(*natural_key, "_survivor.*")
    )


def survivor_map(
    df: DataFrame,
    natural_key: Sequence[str],
    id_column: str,
    survivor_column: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every id with the id that survives for its natural key.

    A natural key shared by very many ids (a placeholder email, say) is spread over tasks.
    """
    members = df.filter(_present([*natural_key, id_column])).select(id_column, *natural_key)
    groups = members.groupBy(*natural_key).agg(
        F.min(id_column).alias(survivor_column), F.count("*").alias("_members")
    )
    hot = hottest(groups, natural_key, "_members", hot_rows)
    return spread_join(members, groups.drop("_members"), natural_key, hot).select(
        id_column, survivor_column
    )


def rejects(candidates: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """Candidates that were not accepted; with the accepted rows they make up the whole."""
    return candidates.join(accepted.select(key), key, "left_anti")
