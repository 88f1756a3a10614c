"""Near-duplicate documents by bottom-k sketches.

Every document's word shingles get one hash function; the k smallest values are its sketch.
Inverted lists of the retained values propose pairs, an estimate from the union of two sketches
filters them, and the exact Jaccard similarity of the full shingle sets decides: at once where both sketches hold the
whole sets, else from the texts.

Texts with equal shingle sets are one class from the start, with a number of its own: classes are compared, and
only components are led back to documents, so a doc_id may stand on any number of texts. Values are ordered by how many
classes hold them, and a class enters only the lists of its rarest values: two sketches that share at
least `need` values must meet in those (prefix filtering). The least overlap `need` is six standard
deviations below what similarity 0.75 gives, so a true pair is missed with probability about 1e-9. That
runs twice: short sketches leave the classes that can have a partner at all, and those get longer
sketches, which decide more sharply.

Lists aren't expanded into all pairs. In a round each member of a list meets one member of it only, another one in each round; in
the first round that of a long list is the one that shares most with others;
confirmed links make components, and lists within one component are done. Rounds go on while the candidate pairs between
components, estimated from a sample of members, are more than an eighth of the rows that the lists had at first and links are
still found; only then are all the pairs that are left compared.
So a group of copies of any size costs rows in proportion to its size. What is joined with the lists is a table by
then, not an aggregate in the same stage, so adaptive execution can split a list of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.graph import components
from gridloom.llm.textkit import mix, shingle_sets
from gridloom.llm.workspace import discard, stored

K = 64
K_LONG = 1024
WIDTH = 5
#: Ids are broadcast to the scan of the texts up to this many (8 MB); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000

#: Candidate pairs for each row that the lists had at first, up to which all that are left are compared at once, and the most
#: rounds before that.
PAIRS_PER_ROW = 0.125
#: The number is estimated from one in SAMPLED members, or counted where the lists can't hold more pairs than this.
EXACT_PAIRS, SAMPLED = 100_000, 256
ROUNDS = 10
#: Pairs of a class whose texts are compared in such a round, the likeliest first; pairs of whole sets need no texts.
BEST = 8
#: Lists from this length on are met first by the member amid the others; in shorter ones any member does.
LONG_LIST = 64

SKETCH = "doc_id long, h long, n long, d1 long, d2 long, sk binary"


def _floor(p: float, k: int) -> float:
    """Six standard deviations below the share p in a sample of k."""
    return p - 6 * math.sqrt(p * (1 - p) / k)


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, h, text: h tells the texts of one doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def sketches(texts: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d1, d2, sk = [], [], [], []
            for s in shingle_sets(b.column(2), width):
                n.append(len(s))
                d1.append(int(mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                d2.append(int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if len(s) else 0)
                sk.append(s[:k].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sk, pa.binary())], names=["doc_id", "h", "n", "d1", "d2", "sk"])

    return texts.select("doc_id", "h", "text").mapInArrow(run, SKETCH)


def _postings(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sk = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(2)]
            rep = np.repeat(np.arange(len(sk)), [len(x) for x in sk])
            v = np.concatenate(sk) if sk else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v), b.column(0).take(pa.array(rep)), b.column(1).take(pa.array(rep))], names=["v", "doc_id", "n"])

    return classes.select("doc_id", "n", "sk").mapInArrow(run, "v long, doc_id long, n long")


def prefix_lists(classes: DataFrame, similarity: float, k: int) -> DataFrame:
    """(v, doc_id, n, need, room): the lists that a class enters, the overlap that it needs, and the most it
    can still reach from this value on, in the common order of values."""
    least = max(1, math.ceil(k * _floor(similarity, k)))
    posts = _postings(classes)
    shared = stored(posts.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    met = posts.join(shared, "v")
    by = Window.partitionBy("doc_id")
    kept = F.least(F.col("n"), F.lit(k))
    met = met.withColumn("need", F.least(F.lit(least), F.ceil(F.col("n") * similarity)))
    met = met.withColumn("met", F.count("*").over(by)).filter("met >= need")
    met = met.withColumn("room", F.col("met") - F.row_number().over(by.orderBy("df", "v")) + 1)
    return met.filter("room >= need").select("v", "doc_id", "n", "need", "room")


def _only(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id (the number of the class), h and text of the rows that keys (id, h, class) name, each once."""
    ids = keys.select("id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    some = texts.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi")
    return some.join(keys, ["id", "h"]).dropDuplicates(["id", "h"]).select(F.col("class").alias("doc_id"), "h", "text")


def _likely(pairs: DataFrame, classes: DataFrame, similarity: float, k: int) -> DataFrame:
    """Pairs (a, b) whose union sketch doesn't rule the similarity out, with the estimate. Sketches that
    hold both whole sets decide as verified() does, and the pair is sure."""
    low, percent = max(0.0, _floor(similarity, k)), round(100 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            est, ok, sure = [], [], []
            for na, x, nb, y in zip(b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist(), b.column(5), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = np.intersect1d(x, y, assume_unique=True)
                sure.append(max(na, nb) <= k)
                if sure[-1]:
                    union = len(x) + len(y) - len(common)
                    est.append(len(common) / max(union, 1))
                    ok.append(len(common) > 0 and 100 * len(common) >= percent * union)
                else:
                    union = np.union1d(x, y)
                    size = min(k, len(union))
                    est.append(float((common <= union[size - 1]).sum()) / size)
                    ok.append(est[-1] >= low)
            est, ok, sure = np.array(est, float), pa.array(ok, pa.bool_()), pa.array(sure, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.filter(ok) for x in (b.column(0), b.column(1), pa.array(est), sure)], names=["a", "b", "est", "sure"])

    left = classes.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sk").alias("ka"))
    right = classes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sk").alias("kb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "ka", "nb", "kb").mapInArrow(run, "a long, b long, est double, sure boolean")


def verified(pairs: DataFrame, texts: DataFrame, keys: DataFrame, similarity: float, width: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have the similarity; compared as integers of a percent."""
    percent = round(100 * similarity)
    ids = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    texts = stored(_only(texts, stored(keys.join(ids, "class"), "ids")), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(shingle_sets(b.column(2), width), shingle_sets(b.column(3), width), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    sure = stored(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "links")
    discard(texts)
    return sure


def _alike(na: str, nb: str, similarity: float):
    return (F.col(na) >= F.col(nb) * similarity) & (F.col(nb) >= F.col(na) * similarity)


def _labelled(lists: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The lists with each class's component; lists within one component are done and go."""
    if comp is None:
        return lists.withColumn("c", F.col("doc_id"))
    every = lists.drop("c").join(comp.select(F.col("u").alias("doc_id"), F.col("v").alias("c")), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    every = stored(every, "components")
    mixed = stored(every.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("v"), "mixed")
    named = stored(every.join(mixed, "v").select("v", "doc_id", "n", "need", "room", "c"), "named")
    discard(every, mixed)
    return named


def _amount(named: DataFrame) -> tuple[int, int]:
    """Rows of the lists, and pairs of members of one list in different components."""
    each = named.groupBy("v", "c").agg(F.count("*").alias("k")).groupBy("v").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("own"))
    m = F.col("m").cast("double")
    r = each.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum((m * m - F.col("own")) / 2), F.lit(0.0))).first()
    return int(r[0]), int(r[1])


def links(docs: DataFrame, made: DataFrame, similarity: float = 0.75, k: int = K, long: int = K_LONG, width: int = WIDTH, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) between classes, and the classes: (class, d1, d2, n, id, h), where id and h name the
    smallest member."""
    full = made.filter("n > 0 and doc_id is not null")
    first = full.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "h")).alias("m"))
    member = stored(first.select(F.monotonically_increasing_id().alias("class"), "d1", "d2", "n", F.col("m.doc_id").alias("id"), F.col("m.h").alias("h")), "classes")
    texts = _hashed(docs)
    named = member.select("class", F.col("id").alias("doc_id"), "h")
    classes = full.select("doc_id", "h", "n", "sk").join(named, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select(F.col("class").alias("doc_id"), "n", "sk")
    able = prefix_lists(classes, similarity, k).select(F.col("doc_id").alias("class")).distinct()
    keys = stored(member.select("class", "id", "h").join(able, "class"), "able")
    classes = stored(sketches(_only(texts, keys), long, width), "longer")
    lists = stored(prefix_lists(classes, similarity, long), "lists")
    exact = F.ceil((F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-9)
    # of the values that both hold, the longer sketch is expected to show this many; six deviations less is safe
    shown = F.floor(similarity / (1 + similarity) * (1 + F.least("na", "nb") / F.greatest("na", "nb")) * long - 6 * math.sqrt(long * similarity * (1 - similarity)))
    overlap = F.when(F.greatest("na", "nb") <= long, exact).otherwise(F.greatest("need_a", "need_b", shown))
    meet = _alike("na", "nb", similarity) & (F.col("ca") != F.col("cb")) & (F.least("room_a", "room_b") >= overlap)
    edges, comp, found_any, most = None, None, True, 0
    side = lambda t, k: t.select("v", F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("need").alias(f"need_{k}"), F.col("room").alias(f"room_{k}"), F.col("c").alias(f"c{k}"))
    for turn in range(rounds + 1):
        named = _labelled(lists, comp)
        rows, upper = _amount(named)
        if turn == 0:
            most = PAIRS_PER_ROW * rows
        last = turn == rounds or not found_any or upper <= most
        if turn and not last:
            # pairs of a few members with all others in their lists; lists differ too much for a sample of lists
            share = 1 if upper <= EXACT_PAIRS else SAMPLED
            some = named.filter(F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(share)) == 0)
            seen = side(some, "a").join(side(named, "b"), "v").filter(meet).count()
            last = share * seen / 2 <= most and (share == 1 or not some.isEmpty())
        y, heads = side(named, "b"), None
        if not last:
            cells = ["doc_id", "n", "need", "room", "c"]
            first = F.min(F.struct((F.col("doc_id") if turn == 0 else F.xxhash64("c", "doc_id", F.lit(turn))).alias("first"), *cells))
            if turn == 0:
                # what has most of the commoner values lies amid its likes, and most of them are linked with it
                amid = F.min(F.struct((-F.col("room") / F.least("n", F.lit(long))).alias("first"), *cells))
                pick = F.when(F.count("*") >= LONG_LIST, F.struct(*[amid[c].alias(c) for c in cells])).otherwise(F.struct(*[first[c].alias(c) for c in cells]))
            else:
                pick = F.struct(*[first[c].alias(c) for c in cells])
            heads = stored(named.groupBy("v").agg(pick.alias("h")).select("v", "h.*"), "heads")
        x = side(named if last else heads, "a")
        pairs = x.join(y, "v").filter(meet & F.expr("a < b") if last else meet).select("a", "b").distinct()
        likely = stored(_likely(pairs, classes, similarity, long), "likely")
        sure, open_ = likely.filter("sure"), likely.filter("not sure")
        if not open_.isEmpty():
            if not last:
                best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("est"), "a"))
                open_ = open_.withColumn("best", best).filter(F.col("best") <= BEST)
            sure = sure.select("a", "b").union(verified(open_, texts, keys, similarity, width))
        sure = sure.select(F.col("a").alias("u"), F.col("b").alias("v"))
        discard(heads)
        edges = sure if edges is None else edges.union(sure)
        if last:
            break
        found_any = not sure.isEmpty()
        if found_any:
            comp = components(edges)
        if turn:
            discard(lists)
            lists = named  # what is done is gone for good
    return edges, member


def near_duplicates(docs: DataFrame, similarity: float = 0.75, k: int = K, long: int = K_LONG, width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are maximal runs without white space, after lower-casing A-Z. Null, empty and blank
    texts have no shingles and are linked with nothing. Rows with equal doc_id are one document, whose links
    are pooled. Rows with a null doc_id are returned with a null component and kept."""
    made = stored(sketches(_hashed(docs), k, width), "sketches")
    edges, member = links(docs, made, similarity, k, long, width)
    rows = made.filter("n > 0 and doc_id is not null")
    twice = stored(rows.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id"), "twice")
    if not twice.isEmpty():
        # the classes of one doc_id's texts are linked with the first of them
        own = stored(rows.join(twice, "doc_id").join(member.select("class", "d1", "d2", "n"), ["d1", "d2", "n"]).select("doc_id", "class").distinct(), "own")
        edges = edges.union(own.join(own.groupBy("doc_id").agg(F.min("class").alias("u")), "doc_id").select("u", F.col("class").alias("v")).filter("u <> v"))
    group = member.join(components(edges).toDF("class", "c"), "class", "left").withColumn("c", F.coalesce("c", "class"))
    group = group.join(group.groupBy("c").agg(F.min("id").alias("least")), "c")
    same = rows.join(stored(group.select("d1", "d2", "n", "least"), "groups"), ["d1", "d2", "n"])
    comp = same.select(F.col("doc_id").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct()
    out = made.select("doc_id", F.col("n").alias("n_shingles")).join(comp.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def copies(docs: DataFrame, similarity: float = 0.75, k: int = K, long: int = K_LONG, width: int = WIDTH) -> DataFrame:
    """(doc_id, h) of the texts that are near copies of another with a smaller doc_id, or a smaller h, xxhash64
    of the text, at the same doc_id. Each text counts for itself: another text of its doc_id doesn't take it along."""
    made = stored(sketches(_hashed(docs), k, width), "sketches")
    edges, member = links(docs, made, similarity, k, long, width)
    comp = components(edges).toDF("class", "c")
    group = member.join(comp, "class", "left").withColumn("c", F.coalesce("c", "class"))
    best = group.groupBy("c").agg(F.min(F.struct("id", "h")).alias("m"))
    group = group.join(best, "c").select("d1", "d2", "n", "m")
    rows = made.filter("n > 0 and doc_id is not null").join(group, ["d1", "d2", "n"])
    return rows.filter((F.col("doc_id") != F.col("m.id")) | (F.col("h") != F.col("m.h"))).select("doc_id", "h").distinct()
