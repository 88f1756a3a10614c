"""Passages of a benchmark inside a corpus, by a positional inverted index.

The index is a table of (term, document, position) for the benchmark's terms. For each window of 13
item words the rarest terms (by postings) are looked up: two for whole windows, and one more for each word
that may differ, so that two of them agree in every window that is searched for. Their offset-adjusted lists
are intersected, which leaves few alignments of an item with a document. For those the lists of all
the item's terms are intersected at the same offsets; runs of agreeing words that hold a window are
hits, and windows of which at least 10 words agree are proximity matches. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.workspace import stored

WIDTH = 13
NEAR = 10
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables of terms, item words and document keys are broadcast up to this many rows; beyond it joins are shuffled.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words after lower-casing A-Z alone; none for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BREAKS), "")


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_id, doc_id, h, pos) for words in terms, and for every row one posting of term -1 at the
    position n_words. h is a hash of the text: rows of one doc_id and different texts stay apart."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.posexplode(F.concat(words(text), F.array(F.lit("")))).alias("pos", "word"))
    return stored(rows.join(terms, "word").select("term_id", "doc_id", "h", "pos"), "index")


def _items(bench: DataFrame) -> DataFrame:
    """(item_id, ipos, word, size): the words of the items; items of equal item_id are told apart by text."""
    rows = bench.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter("size(w) > 0").distinct()
    return stored(rows.select("item_id", F.xxhash64("w").alias("g"), F.size("w").alias("size"), F.posexplode("w").alias("ipos", "word")), "items")


def matches(docs: DataFrame, bench: DataFrame, width: int = WIDTH, near: int = NEAR) -> tuple[DataFrame, DataFrame]:
    """The agreeing words of documents with items: (doc_id, h, item_id, pos, exact, close), and the index.

    exact: the word lies in an occurrence of a window; close: in a stretch of `width` item words of
    which at least `near` agree at the same offsets. An item of fewer words is one window, of which `near` or all agree."""
    items = _items(bench)
    terms = stored(items.select("word").distinct().withColumn("term_id", F.monotonically_increasing_id()).union(docs.sparkSession.createDataFrame([("", -1)], "word string, term_id long")), "terms")
    index = build_index(docs, _small(terms))
    df = index.filter("term_id >= 0").groupBy("term_id").agg(F.count("*").alias("df"))
    known = items.join(terms, "word").join(df, "term_id", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    own = Window.partitionBy("item_id", "g")
    ahead = own.orderBy("ipos").rowsBetween(0, width - 1)
    rare = F.array_sort(F.collect_list(F.struct("df", "ipos", "term_id")).over(ahead))
    starts = known.withColumn("rare", rare).filter(F.col("ipos") <= F.greatest(F.col("size") - width, F.lit(0)))
    # all but `length - agree` words of a window agree: of any that many and `need` more, at least `need`
    length, agree = F.least(F.lit(width), F.col("size")), F.least(F.lit(near), F.col("size"))
    need = F.least(F.lit(2), agree)
    looked = starts.select("item_id", "g", need.alias("need"), F.explode(F.slice("rare", F.lit(1), length - agree + need)).alias("r"))
    anchors = stored(looked.select("item_id", "g", "need", F.col("r.term_id").alias("term_id"), F.col("r.ipos").alias("at")).distinct(), "anchors")
    listed = index.join(_small(anchors), "term_id").select("item_id", "g", "need", "doc_id", "h", "at", (F.col("pos") - F.col("at")).alias("shift"))
    met = listed.groupBy("item_id", "g", "doc_id", "h", "shift").agg(F.count("*").alias("met"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.max("need").alias("need"))
    together = (F.col("met") >= F.col("need")) & ((F.col("met") > 2) | (F.col("hi") - F.col("lo") < width))
    lined = stored(met.filter(together).select("item_id", "g", "doc_id", "h", "shift"), "alignments")
    some = _small(lined.select("doc_id", "h").distinct()).alias("s")
    local = index.filter("term_id >= 0").alias("x").join(some, (F.col("x.h") == F.col("s.h")) & F.col("x.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi")
    wanted = lined.join(_small(known.select("item_id", "g", "ipos", "size", "term_id")), ["item_id", "g"]).withColumn("pos", F.col("shift") + F.col("ipos")).alias("y")
    local = local.distinct().alias("x")
    met = wanted.join(local, (F.col("x.h") == F.col("y.h")) & F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.pos") == F.col("y.pos")) & (F.col("x.term_id") == F.col("y.term_id"))).select("y.item_id", "y.g", "y.doc_id", "y.h", "y.shift", "y.ipos", "y.size", "y.pos")
    line = Window.partitionBy("item_id", "g", "doc_id", "h", "shift")
    met = met.withColumn("run", F.col("ipos") - F.row_number().over(line.orderBy("ipos")))
    met = met.withColumn("length", F.count("*").over(Window.partitionBy("item_id", "g", "doc_id", "h", "shift", "run")))
    met = met.withColumn("exact", F.col("length") >= F.least(F.lit(width), F.col("size")))
    before = F.count("*").over(line.orderBy("ipos").rangeBetween(-(width - 1), 0))
    met = met.withColumn("close", F.max(F.when(before >= F.least(F.lit(near), F.col("size")), 1).otherwise(0)).over(line.orderBy("ipos").rangeBetween(0, width - 1)) == 1)
    return met.select("doc_id", "h", "item_id", "pos", "exact", "close"), index


def contamination(docs: DataFrame, bench: DataFrame, width: int = WIDTH, near: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and h.

    A null text has no words. Items that are null or without words match nothing; an item of fewer words than
    width is one window. contaminated: 20 * n_hit >= n_words and n_hit > 0. With near there are also n_near,
    n_near_items and near_items_sha256: the same of the words and items that match by proximity, exact ones included."""
    met, index = matches(docs, bench, width, near or width)
    if near:
        met = stored(met, "met")
    out = index.filter("term_id = -1").select("doc_id", "h", F.col("pos").cast("long").alias("n_words"))
    for kind, n, items in (("exact", "n_hit", "items"), ("close", "n_near", "near_items"))[: 2 if near else 1]:
        hits = met.filter(kind).select("doc_id", "h", "item_id", "pos")
        hit = hits.select("doc_id", "h", "pos").distinct().groupBy("doc_id", "h").agg(F.count("*").alias(n))
        found = hits.select("doc_id", "h", "item_id").distinct().groupBy("doc_id", "h").agg(F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias(items), F.count("*").alias(f"n_{items}"))
        both = stored(hit.alias("a").join(found.alias("b"), (F.col("a.h") == F.col("b.h")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))).select("a.doc_id", "a.h", n, f"n_{items}", items), "hits").alias("z")
        out = out.alias("r").join(both, (F.col("r.h") == F.col("z.h")) & F.col("r.doc_id").eqNullSafe(F.col("z.doc_id")), "left").select("r.*", n, f"n_{items}", items)
    out = out.fillna(0, [c for c in out.columns if c in ("n_hit", "n_items", "n_near", "n_near_items")])
    sha = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256).alias(f"{c}_sha256")
    extra = ["n_near", "n_near_items", sha("near_items")] if near else []
    return out.select("doc_id", "n_words", "n_hit", "n_items", sha("items"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *extra, "h")
