"""Dependencies between columns: discovery, application and exact inversion.

Candidates come from one aggregate (which rejects columns with nulls); affine ones are proposed by a least-squares slope of a strided
sample, but only an exact proof over all rows in integer arithmetic accepts them.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.entropy import order0

#: Denominators that a slope may have (fixed values).
DENOMINATORS = (1, 2, 4, 5, 8, 10, 100)
WIDE = "decimal(38,0)"
#: Columns that no step may remove unless the caller says so (fixed value).
PROTECTED = frozenset({"bit_fields"})


@dataclass(frozen=True)
class Step:
    kind: str  # constant, duplicate, affine or residual
    target: str
    source: str | None = None
    value: int = 0
    num: int = 1
    den: int = 1
    b: int = 0


def _facts(df: DataFrame, cols: list[str], *, ends: bool = False, same: bool = False, slopes: bool = False):
    """One row with what is asked for of each column (lo, hi) and of each pair of an earlier source and a later target
    (same, slope), from one pass. A column with nulls is an error: no step could give them back."""
    pairs = [(cols[j], cols[i]) for j in range(len(cols)) for i in range(j)]
    aggs = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"null{k}") for k, c in enumerate(cols)]
    if ends:
        aggs += [f(c).alias(f"{n}{k}") for k, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]
    for k, (a, b) in enumerate(pairs):
        aggs += [F.min((F.col(a) == F.col(b)).cast("int")).alias(f"same{k}")] if same else []
        aggs += [F.regr_slope(a, b).alias(f"slope{k}")] if slopes else []
    r = df.agg(*aggs).first() if aggs else None
    holes = [c for k, c in enumerate(cols) if r[f"null{k}"]]
    if holes:
        raise ValueError(f"columns with nulls have no exact representation: {', '.join(holes)}")
    return r, pairs


def _constants(r, cols: list[str]) -> dict[str, int]:
    return {c: r[f"lo{k}"] for k, c in enumerate(cols) if r[f"lo{k}"] is not None and r[f"lo{k}"] == r[f"hi{k}"]}


def constants(df: DataFrame, cols: list[str]) -> dict[str, int]:
    return _constants(_facts(df, cols, ends=True)[0], cols)


def duplicates(df: DataFrame, cols: list[str]) -> list[tuple[str, str]]:
    """(target, source) of equal columns, source earlier; all pairs in one pass."""
    r, pairs = _facts(df, cols, same=True)
    return [p for k, p in enumerate(pairs) if r[f"same{k}"] == 1]


def affines(df: DataFrame, cols: list[str], stride: int = 1) -> list[Step]:
    """Proven target = (num * source + b) / den for every pair of an earlier source and a later target."""
    s = df.filter(F.col("pos") % stride == 0) if stride > 1 else df
    r, pairs = _facts(s, cols, slopes=True)
    return _proven(df, pairs, [r[f"slope{k}"] for k in range(len(pairs))])


def _proven(df: DataFrame, pairs: list[tuple[str, str]], slopes: list) -> list[Step]:
    tries = []
    for (a, b), slope in zip(pairs, slopes, strict=True):
        if slope is None or slope == 0:
            continue
        for d in DENOMINATORS:
            num = round(slope * d)
            if num and abs(slope * d - num) < 1e-3 * max(1.0, abs(num)):
                tries.append((a, b, num, d))
                break
    if not tries:
        return []
    rest = [F.col(a).cast(WIDE) * d - F.col(b).cast(WIDE) * num for a, b, num, d in tries]
    r = df.agg(*[f(e).alias(f"{n}{k}") for k, e in enumerate(rest) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return [Step("affine", a, b, 0, num, d, int(r[f"lo{k}"])) for k, (a, b, num, d) in enumerate(tries) if r[f"lo{k}"] is not None and r[f"lo{k}"] == r[f"hi{k}"]]


def residuals(df: DataFrame, cols: list[str], gain: float = 1.0) -> list[tuple[str, str, float, float]]:
    """(target, source, h, h of the difference) where the best earlier source saves `gain` bits a row."""
    if len(cols) < 2:
        return []
    names = {c: F.col(c) for c in cols} | {f"{cols[j]}-{cols[i]}": F.col(cols[j]) - F.col(cols[i]) for j in range(len(cols)) for i in range(j)}
    h = {r["col"]: r["h"] for r in order0(df, names).collect()}
    out = []
    for j, c in enumerate(cols):
        found = sorted((h[f"{c}-{s}"], s) for s in cols[:j] if f"{c}-{s}" in h)
        if found and h[c] - found[0][0] >= gain:
            out.append((c, found[0][1], h[c], found[0][0]))
    return out


def analyze(df: DataFrame, cols: list[str], protected: frozenset[str] = PROTECTED, residual: bool = True) -> list[Step]:
    """A plan in the order constants, duplicates and affines, residuals. Sources are earlier columns that
    stay; a residual target is no source of a later residual; protected columns are never targets."""
    plan: list[Step] = []
    gone: set[str] = set()
    if not cols:
        return []
    r, pairs = _facts(df, cols, ends=True, same=True, slopes=True)
    for c, v in _constants(r, cols).items():
        if c not in protected:
            plan.append(Step("constant", c, None, int(v)))
            gone.add(c)
    rest = [c for c in cols if c not in gone]
    open_ = [k for k, (a, b) in enumerate(pairs) if a not in gone and b not in gone]
    twins = [pairs[k] for k in open_ if r[f"same{k}"] == 1]
    lines = _proven(df, [pairs[k] for k in open_], [r[f"slope{k}"] for k in open_])
    for c in rest:
        if c in protected:
            continue
        same = [s for t, s in twins if t == c and s not in gone]
        line = [x for x in lines if x.target == c and x.source not in gone]
        if same:
            plan.append(Step("duplicate", c, same[0]))
            gone.add(c)
        elif line:
            plan.append(line[0])
            gone.add(c)
    if residual:
        used: set[str] = set()
        rest = [c for c in rest if c not in gone]
        for c, s, _, _ in residuals(df, rest):
            if c not in protected and s not in used:
                plan.append(Step("residual", c, s))
                used.add(c)
    return plan


def apply(df: DataFrame, plan: list[Step]) -> DataFrame:
    """The columns that stay; residual targets become differences to their sources."""
    diff = {s.target: F.col(s.target) - F.col(s.source) for s in plan if s.kind == "residual"}
    return df.withColumns(diff).drop(*[s.target for s in plan if s.kind != "residual"])


def invert(df: DataFrame, plan: list[Step]) -> DataFrame:
    """All columns again, in waves: a step runs once its source is whole. A cycle is an error."""
    left = {s.target for s in plan}
    todo = list(plan)
    while todo:
        ready = [s for s in todo if s.source is None or s.source not in left]
        if not ready:
            raise ValueError("the plan has a cycle")
        df = df.withColumns({s.target: _rebuilt(s) for s in ready})
        left -= {s.target for s in ready}
        todo = [s for s in todo if s.target in left]
    return df


def _rebuilt(s: Step) -> Column:
    if s.kind == "constant":
        return F.lit(s.value).cast("long")
    if s.kind == "duplicate":
        return F.col(s.source)
    if s.kind == "residual":
        return F.col(s.target) + F.col(s.source)
    return F.expr(f"cast((cast(`{s.source}` as {WIDE}) * {s.num} + {s.b}) div {s.den} as bigint)")


def plan_bytes(plan: list[Step], packed: bool = True) -> bytes:
    """The plan as JSON, packed by deflate or as it stands."""
    text = json.dumps([asdict(s) for s in plan], separators=(",", ":")).encode()
    return zlib.compress(text, 9) if packed else text


def plan_from(data: bytes) -> list[Step]:
    """The plan of plan_bytes(), packed or not."""
    return [Step(**s) for s in json.loads(data if data[:1] == b"[" else zlib.decompress(data))]


def plan_rows(df: DataFrame, plan: list[Step]) -> DataFrame:
    rows = [(k, *asdict(s).values()) for k, s in enumerate(plan)]
    return df.sparkSession.createDataFrame(rows, "seq int, kind string, target string, source string, value long, num long, den long, b long")


def differences_between(a: DataFrame, b: DataFrame, cols: list[str], key: str = "pos") -> DataFrame:
    """(col, mismatches, first_pos): rows whose values differ or that one side lacks."""
    both = a.select(key, *cols).join(b.select(key, *[F.col(c).alias(f"_{c}") for c in cols], F.lit(1).alias("_here")), key, "full_outer")
    wrong = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), (~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias("bad")) for c in cols]))
    each = both.select(key, wrong.alias("s"))
    return each.groupBy(F.col("s.col").alias("col")).agg(F.sum(F.col("s.bad").cast("long")).alias("mismatches"), F.min(F.when(F.col("s.bad"), F.col(key))).alias("first_pos"))


def coverage(a: DataFrame, b: DataFrame, key: str = "pos") -> DataFrame:
    """(col, status, mismatches) for each column of a: same, differs or missing in b, and in how many rows."""
    here = {c.lower() for c in b.columns}
    cols = [c for c in a.columns if c != key]
    both = [c for c in cols if c.lower() in here]
    n = F.when(F.col("mismatches") == 0, "same").otherwise("differs")
    lost = [F.lit(c) for c in cols if c not in both]
    gone = a.agg(F.count("*").alias("mismatches")).select(F.explode(F.array(*lost)).alias("col"), "mismatches") if lost else None
    out = differences_between(a, b, both, key).select("col", n.alias("status"), "mismatches") if both else None
    if gone is None:
        return out
    gone = gone.select("col", F.lit("missing").alias("status"), "mismatches")
    return out.union(gone) if out is not None else gone
