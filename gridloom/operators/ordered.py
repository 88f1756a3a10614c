"""Operators over storage order, computed block by block with a halo of earlier rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import MODES, bitlen, predicted, wsub, zigzag
from gridloom.sources.views import BLOCK


#: A gap of more than this many times the median starts a session (fixed value).
GAP_FACTOR = 20.0


def with_lags(df: DataFrame, lags: dict[str, tuple[str | Column, int]], block: int = BLOCK, order: str = "pos", keep: tuple[str, ...] = ()) -> DataFrame:
    """df with name = value of the column `offset` rows earlier. order must be dense from 0.

    Each row goes to its block, and rows near a block's end also to the next one as a halo, so that
    lags are exact across blocks and no task sorts more than a block."""
    halo = max(k for _, k in lags.values())
    at = F.floor(F.col(order) / block)
    both = F.when(F.pmod(F.col(order), F.lit(block)) >= block - halo, F.array(at, at + 1)).otherwise(F.array(at))
    w = Window.partitionBy("_b").orderBy(order)
    out = df.withColumn("_b", F.explode(both)).withColumns({n: F.lag(c, k).over(w) for n, (c, k) in lags.items()})
    return out.filter(F.floor(F.col(order) / block) == F.col("_b")).drop("_b")


def differences(df: DataFrame, cols: list[str], orders: int = 1, order: str = "pos") -> DataFrame:
    """df with c_d1, c_d2, ...: differences against the row before, modulo 2**64; missing rows count as 0."""
    df = with_lags(df, {f"_{c}{k}": (c, k) for c in cols for k in range(1, orders + 1)}, order=order)
    df = df.withColumns({f"_{c}{k}": (F.coalesce(f"_{c}{k}", F.lit(0)) if k else F.col(c)).cast("long") for c in cols for k in range(orders + 1)})
    for n in range(1, orders + 1):  # each order from the one before, in a projection of its own
        df = df.withColumns({f"_{c}{k}": wsub(F.col(f"_{c}{k}"), F.col(f"_{c}{k + 1}")) for c in cols for k in range(orders + 1 - n)} | {f"{c}_d{n}": wsub(F.col(f"_{c}0"), F.col(f"_{c}1")) for c in cols})
    return df.drop(*[f"_{c}{k}" for c in cols for k in range(orders + 1)])


def all_residuals(df: DataFrame, cols: list[str], modes: range | list[int] = range(8), order: str = "pos") -> DataFrame:
    """df with c_r0..c_r7 for each column: residuals of the eight predictors. The first difference is the first value itself."""
    df = with_lags(df, {f"_{c}l{k}": (c, k) for c in cols for k in range(1, 7)}, order=order)
    v = {c: [F.col(f"_{c}l{k}") for k in range(1, 7)] for c in cols}
    df = df.withColumns({f"_{c}d{k}": v[c][k] - F.coalesce(v[c][k + 1], F.lit(0)) for c in cols for k in range(5)})
    out = {f"{c}_r{m}": F.col(c) - predicted(m, v[c][0], [F.col(f"_{c}d{k}") for k in range(5)], F.col(order)) for c in cols for m in modes}
    return df.withColumns(out).drop(*[f"_{c}l{k}" for c in cols for k in range(1, 7)], *[f"_{c}d{k}" for c in cols for k in range(5)])


def mode_residuals(df: DataFrame, col: str, modes: range | list[int] = range(8), order: str = "pos") -> DataFrame:
    """df with r0..r7: the residuals of one column."""
    return all_residuals(df, [col], modes, order).withColumnsRenamed({f"{col}_r{m}": f"r{m}" for m in modes})


def bits(c: str | Column) -> Column:
    return bitlen(zigzag(F.col(c) if isinstance(c, str) else c)).cast("long")


def mode_costs(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, mode, bits): summed bit lengths of every predictor's residuals, of all columns in one pass."""
    r = all_residuals(df.select("pos", *cols), cols)
    r = r.agg(*[F.sum(bits(f"{c}_r{m}")).alias(f"{c}_{m}") for c in cols for m in range(8)])
    cells = [F.struct(F.lit(c).alias("col"), F.lit(name).alias("mode"), F.col(f"{c}_{m}").alias("bits")) for c in cols for m, name in enumerate(MODES)]
    return r.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def segment_choice(df: DataFrame, col: str, segment: int = 1024) -> DataFrame:
    """(seg, mode, bits): the cheapest predictor of every segment, ties to the lower number."""
    r = mode_residuals(df.select("pos", col), col)
    r = r.groupBy(F.floor(F.col("pos") / segment).alias("seg")).agg(*[F.sum(bits(f"r{m}")).alias(f"b{m}") for m in range(8)])
    best = F.least(*[F.col(f"b{m}") for m in range(8)])
    pick = F.lit(7)
    for m in range(6, -1, -1):
        pick = F.when(F.col(f"b{m}") == best, m).otherwise(pick)
    return r.select("seg", pick.cast("int").alias("mode"), best.alias("bits"))


def lifting(df: DataFrame, col: str, levels: int) -> DataFrame:
    """(level, pos, residual): odd multiples of 2**level predicted from both even neighbours."""
    out = None
    for level in range(levels):
        step = 1 << level
        own = df.filter(F.pmod("pos", F.lit(2 * step)) == step).select("pos", col)
        side = df.filter(F.pmod("pos", F.lit(2 * step)) == 0)
        left = side.select((F.col("pos") + step).alias("pos"), F.col(col).alias("_a"))
        right = side.select((F.col("pos") - step).alias("pos"), F.col(col).alias("_b"))
        guess = F.floor((F.col("_a") + F.coalesce("_b", "_a")) / 2).cast("long")
        r = own.join(left, "pos").join(right, "pos", "left").select(F.lit(level).alias("level"), "pos", (F.col(col) - guess).alias("residual"))
        out = r if out is None else out.union(r)
    return out


def sessions(df: DataFrame, factor: float, by: str = "sid", time: str = "gps") -> DataFrame:
    """df with session and gap: a new one starts where the source changes or the gap exceeds factor times
    the upper median of the positive gaps (of all sources; 200 if there are none)."""
    w = Window.partitionBy(by).orderBy(time, "pos")
    gaps = df.withColumn("gap", F.col(time) - F.lag(time).over(w))
    limit = upper_median(gaps.filter("gap > 0"), "gap")
    flag = F.when(F.col("gap").isNull() | (F.col("gap") > F.lit(limit * factor if limit is not None else 200)), 1).otherwise(0)
    return gaps.withColumn("session", F.sum(flag).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def order_statistic(df: DataFrame, col: str, share: float):
    """The value at index floor(n * share) of the sorted column (the last at most); None without rows.

    Counts of distinct values are ranked, not rows."""
    n = df.filter(F.col(col).isNotNull()).count()
    if not n:
        return None
    at = min(n - 1, int(n * share))
    # values are narrowed to one bin of an equal-width histogram before any are sorted
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    rest = df.select(F.col(col).alias("v")).filter("v is not null")
    for _ in range(8):
        if lo == hi or rest.count() <= 100_000:
            break
        width = (hi - lo) / 1000
        bins = sorted(tuple(r) for r in rest.groupBy(F.least(F.lit(999), F.floor((F.col("v") - lo) / width)).alias("b")).agg(F.count("*"), F.min("v"), F.max("v")).collect())
        for _, c, a, z in bins:
            if at < c:
                lo, hi = a, z
                break
            at -= c
        rest = rest.filter((F.col("v") >= lo) & (F.col("v") <= hi))
    if lo == hi:
        return lo
    return rest.groupBy("v").count().orderBy("v").withColumn("c", F.sum("count").over(Window.orderBy("v"))).filter(F.col("c") > at).agg(F.min("v")).first()[0]


def upper_median(df: DataFrame, col: str):
    return order_statistic(df, col, 0.5)


#: A column of at most this many distinct values is classed by frequency (fixed value).
FEW_VALUES = 64


def value_class(df: DataFrame, col: str) -> Column:
    """Class 0 to 3 of a column's values. Of few distinct values the three most frequent (ties to the smaller) are 1, 2
    and 3 and the rest 0; of many, the number of quartiles that a value exceeds."""
    few = df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(FEW_VALUES + 1).collect()
    if len(few) <= FEW_VALUES:
        out = F.lit(0)
        for k, r in enumerate(few[:3]):
            out = F.when(F.col(col) == r[0], k + 1).otherwise(out)
        return out.cast("int")
    cuts = [order_statistic(df, col, q) for q in (0.25, 0.5, 0.75)]
    return sum((F.when(F.col(col) > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def nearest_back(df: DataFrame, cols: list[str], rows: int, block: int = BLOCK) -> DataFrame:
    """df with back, the distance to the row nearest by L1 among the last `rows` ones (ties to the latest; null for the
    first row), and c_b, what it leaves of each column."""
    at = F.floor(F.col("pos") / block)
    both = F.when(F.pmod(F.col("pos"), F.lit(block)) >= block - rows, F.array(at, at + 1)).otherwise(F.array(at))
    w = Window.partitionBy("_b").orderBy("pos").rowsBetween(-rows, -1)
    out = df.withColumn("_b", F.explode(both)).withColumn("_w", F.collect_list(F.struct("pos", *cols)).over(w))
    out = out.filter(F.floor(F.col("pos") / block) == F.col("_b")).drop("_b")
    far = lambda s: sum((F.abs(F.col(c) - s[c]) for c in cols[1:]), F.abs(F.col(cols[0]) - s[cols[0]]))
    best = F.array_min(F.transform("_w", lambda s: F.struct(far(s).alias("l1"), (F.col("pos") - s["pos"]).alias("back"), *[s[c].alias(c) for c in cols])))
    out = out.withColumn("_m", best).drop("_w")
    return out.withColumns({"back": F.col("_m.back"), **{f"{c}_b": F.col(c) - F.col(f"_m.{c}") for c in cols}}).drop("_m")
