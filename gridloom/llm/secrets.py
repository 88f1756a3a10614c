"""Secrets in texts: patterns, and candidate strings whose sliding-window entropy is high.

Everything is a Spark expression. Positions of matches are sums of the lengths of what `split` leaves
between them and of the matches themselves. A candidate is a long run of key characters with letters and digits;
its windows' Shannon entropy is kept by counts that change by the character that comes in and the one that
leaves; the counts are five-bit fields of a few integers. Thresholds depend on the character class; an allow-list
suppresses harmless candidates. The work grows with the length of a text, whatever it holds: no pattern repeats a group,
no character is looked up by its index in a string, and lists are built in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.workspace import fresh

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Least entropy in bits of some window of WINDOW characters, by class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
#: Candidates that are never reported on entropy: UUIDs and well-known example keys.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|placeholder|changeme|xxxx|0000000",
)
#: Those without a letter beside a digit are plain words and numbers joined by marks, and are allowed too.
MIXED = r"[A-Za-z][0-9]|[0-9][A-Za-z]"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Counts of a window in one 64-bit integer: five bits hold any count up to 31.
BITS = 5
PER_WORD = 12
#: Items of a list that are put in place one by one before the block is put behind the others.
BLOCK = 256

SPAN = "struct<start:int,kind:int,end:int,value:string,bstart:int,bend:int>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: as a lambda's variable it isn't copied into inner lambdas, where the
    optimiser would have it computed again for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scanned(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, block: int = BLOCK) -> Column:
    """array<kind> of what step(state, item) -> (next state, value) gives for the items in order.

    Appending to an array copies it, so values are gathered in blocks: the copies stay in proportion
    to the number of items times the larger of block and the number of blocks."""
    none, nested = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, x: Column) -> Column:
        return bound(F.struct(*(v.alias(n) for n, v in zip(("s", "v"), step(acc["s"], x), strict=True))), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["v"])).alias("out")))

    def many(acc: Column, part: Column) -> Column:
        return bound(F.aggregate(part, F.struct(acc["s"].alias("s"), none.alias("out")), one), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def of(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, block))
        return F.flatten(F.aggregate(parts, F.struct(state.alias("s"), nested.alias("out")), many, lambda acc: acc["out"]))

    return bound(items, of)


def located(text: Column, pattern: str, kind: int, ok=lambda whole, group: F.lit(True), group: int = 0) -> Column:
    """array<SPAN> of the leftmost matches that pass ok: start and end in code points, bstart and bend in bytes."""
    found = F.arrays_zip(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start, bstart = at["c"] + F.length(x["between"]), at["b"] + F.octet_length(x["between"])
        end, bend = start + F.length(x["whole"]), bstart + F.octet_length(x["whole"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["whole"].alias("value"), bstart.alias("bstart"), bend.alias("bend"))
        return F.struct(end.alias("c"), bend.alias("b")), F.when(ok(x["whole"], x["part"]), one)

    matched = F.filter(found, lambda x: x["whole"].isNotNull())
    spans = scanned(matched, F.struct(F.lit(0).alias("c"), F.lit(0).alias("b")), step, SPAN)
    return F.when(text.rlike(pattern), F.filter(spans, lambda x: x.isNotNull())).otherwise(F.array().cast(f"array<{SPAN}>"))


def peak_entropy(s: Column, window: int = WINDOW) -> Column:
    """Largest entropy of a window of s (shorter strings: 0), by counts changed one character at a time.

    Each step moves one character in and one out. The sum of c * log2(c) over the counts is kept as an integer
    multiple of 2**-40, so it doesn't drift however long s is."""
    unit = 1 << 40
    gain = [round(unit * (c * math.log2(c) if c else 0)) for c in range(window + 1)]
    more = F.array(*[F.lit(b - a) for a, b in zip(gain, gain[1:], strict=False)])  # what one more of a character adds
    words = [f"n{k}" for k in range(-(-len(ALPHABET) // PER_WORD))]
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in words], F.lit(0).alias("i"), F.lit(0).cast("long").alias("s"), F.lit(1 << 62).alias("low"))

    def counts(codes: Column) -> Column:
        place = F.arrays_zip(codes.alias("come"), F.concat(F.array_repeat(F.lit(-1), window), codes).alias("go"))

        def count(acc: Column, code: Column) -> Column:
            word = F.element_at(F.array(*[acc[n] for n in words]), (code / PER_WORD).cast("int") + 1)
            return F.call_function("shiftright", word, (code % PER_WORD) * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

        def moved(acc: Column, code: Column, by: int, total: Column, i: Column, low: Column) -> Column:
            one = F.lit(by).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), (code % PER_WORD) * BITS)
            at = (code / PER_WORD).cast("int")
            return F.struct(*[F.when(at == k, acc[n] + one).otherwise(acc[n]).alias(n) for k, n in enumerate(words)], i.alias("i"), total.alias("s"), low.alias("low"))

        def leave(acc: Column, go: Column) -> Column:
            return F.when(go < 0, acc).otherwise(moved(acc, go, -1, acc["s"] - F.element_at(more, count(acc, go)), acc["i"], acc["low"]))

        def enter(acc: Column, come: Column) -> Column:
            return bound(
                acc["s"] + F.element_at(more, count(acc, come) + 1),
                lambda total: moved(acc, come, 1, total, acc["i"] + 1, F.when(acc["i"] >= window - 1, F.least(acc["low"], total)).otherwise(acc["low"])),
            )

        step = lambda acc, x: bound(leave(acc, x["go"]), lambda less: enter(less, x["come"]))
        low = F.aggregate(F.filter(place, lambda x: x["come"].isNotNull()), zero, step, lambda acc: acc["low"])
        return bound(low, lambda v: F.when(v == F.lit(1 << 62), F.lit(0.0)).otherwise(F.lit(math.log2(window)) - v / unit / window))

    return bound(F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), counts)


def _suspicious(s: Column) -> Column:
    kind = F.when(s.rlike(r"^[0-9A-Fa-f]+$"), F.lit(THRESHOLDS["hex"])).when(s.rlike(r"^[A-Za-z0-9]+$"), F.lit(THRESHOLDS["alnum"])).otherwise(F.lit(THRESHOLDS["base64"]))
    plain = F.lit(False)
    for pattern in ALLOW:
        plain = plain | s.rlike(pattern)
    return s.rlike(MIXED) & ~plain & (F.round(peak_entropy(s), 9) >= kind)


def secret_spans(docs: DataFrame, base: str = "base", spans: str = "spans") -> DataFrame:
    """docs with base and spans: arrays of SPAN, sorted; kind is an index of KINDS.

    base holds the pattern matches; spans adds runs of high entropy that no base span contains. A null
    text counts as empty. Columns of these names are replaced."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    rows = docs.drop(base, spans)
    assign = located(text, ASSIGN, 0, lambda whole, group: F.length(group) >= 8, 1)
    rows = rows.withColumn(base, F.array_sort(F.concat(assign, located(text, ACCESS, 1), located(text, HEX, 2))))
    rows = rows.withColumn(spans, F.when(text.rlike(CANDIDATE), located(text, CANDIDATE, 3)).otherwise(none))

    def outside(reach: Column, x: Column) -> tuple[Column, Column]:
        # in order of start base spans come first, so a candidate lies in one if any so far reaches its end
        return F.when(x["kind"] < 3, F.greatest(reach, x["end"])).otherwise(reach), F.when((x["kind"] == 3) & (reach < x["end"]), x)

    free = F.filter(scanned(F.array_sort(F.concat(base, spans)), F.lit(0), outside, SPAN), lambda x: x.isNotNull())
    rows = rows.withColumn(spans, F.when((F.size(base) > 0) & (F.size(spans) > 0), free).otherwise(F.col(spans)))
    rows = rows.withColumn(spans, F.when(F.size(spans) > 0, F.filter(spans, lambda e: _suspicious(e["value"]))).otherwise(F.col(spans)))
    return rows.withColumn(spans, F.array_sort(F.concat(base, spans)))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    found = secret_spans(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(F.col("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by mark (touching or overlapping spans by one); texts without
    spans and null texts stay as they are."""
    base, spans = fresh(docs, "secret_base"), fresh(docs, "secret_spans")
    found = secret_spans(docs, base, spans)
    gap = "struct<lo:int,hi:int>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(at, s["bend"]), F.when(s["bstart"] > at, F.struct(F.greatest(at, F.lit(0)).alias("lo"), s["bstart"].alias("hi")))

    def pieces(raw: Column) -> Column:
        between = F.filter(scanned(F.col(spans), F.lit(-1), step, gap), lambda x: x.isNotNull())
        last = F.struct(F.array_max(F.transform(spans, lambda s: s["bend"])).alias("lo"), F.length(raw).alias("hi"))
        kept = F.transform(F.concat(between, F.array(last)), lambda g: F.substring(raw, g["lo"] + 1, g["hi"] - g["lo"]).cast("string"))
        return F.array_join(kept, mark)

    clean = bound(F.col("text").cast("string").cast("binary"), pieces)
    return found.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(F.col("text"))).select(docs.columns)
