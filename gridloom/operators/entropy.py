"""Entropy aggregates: all columns of a call share one pass and one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(c: Column, places: int = 6) -> Column:
    return F.round(c, places)


def stacked(df: DataFrame, rows: list[tuple[Column | str, ...]], names: tuple[str, ...]) -> DataFrame:
    """(k, *names): a row for each tuple of long values, k its place; the places are integers, which group faster than names."""
    cells = [x for k, row in enumerate(rows) for x in (F.lit(k), *[(F.col(v) if isinstance(v, str) else v).cast("long") for v in row])]
    return df.select(F.stack(F.lit(len(rows)), *cells).alias("k", *names))


def named(k: str, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.col(k) + 1)


def unpivot(df: DataFrame, cols: dict[str, Column | str]) -> DataFrame:
    """(col, v): one row for each named value."""
    pairs = [F.struct(F.lit(n).alias("col"), (F.col(c) if isinstance(c, str) else c).alias("v")) for n, c in cols.items()]
    return df.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")


def _bits(count: Column) -> Column:
    return F.log2(F.sum(count)) - F.sum(count * F.log2(count)) / F.sum(count)


def counts(df: DataFrame, cols: dict[str, Column | str]) -> DataFrame:
    """(k, v, c): how often each column, by its place, has each integer value; nulls are left out."""
    return stacked(df, [(c,) for c in cols.values()], ("v",)).filter("v is not null").groupBy("k", "v").agg(F.count("*").alias("c"))


def order0(df: DataFrame, cols: dict[str, Column | str]) -> DataFrame:
    """(col, n, h): rows and order-0 Shannon entropy in bits of integer columns; nulls are left out."""
    h = counts(df, cols).groupBy("k").agg(F.sum("c").alias("n"), rounded(_bits(F.col("c"))).alias("h"))
    return h.select(named("k", list(cols)).alias("col"), "n", "h")


def conditional(df: DataFrame, pairs: dict[str, tuple[Column | str, Column | str]]) -> DataFrame:
    """(col, joint, given, conditional) for each symbol and context: H(a, c), H(c) and H(a | c)."""
    cells = stacked(df, list(pairs.values()), ("a", "c")).groupBy("k", "a", "c").agg(F.count("*").alias("m"))
    # sums over the cells of a context give both entropies
    part = cells.groupBy("k", "c").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.log2("m")).alias("t"))
    joint = F.log2(F.sum("m")) - F.sum("t") / F.sum("m")
    h = part.groupBy("k").agg(joint.alias("joint"), _bits(F.col("m")).alias("given"))
    return h.select(named("k", list(pairs)).alias("col"), rounded(F.col("joint")).alias("joint"), rounded(F.col("given")).alias("given"), rounded(F.col("joint") - F.col("given")).alias("conditional"))
