"""Languages of texts and of the spans of mixed-language texts.

The script of a word (from the range of its first letter) narrows the candidate languages to those whose training texts
use it. A word's score for a language is the mean log-odds of its hashed form and of its
hashed first and last three bytes. The Viterbi path over the words, with a penalty for
each switch, labels the spans; the language of the text is the one with most bytes in spans, where the
first span's bytes count `lead` times more. Training picks lead by accuracy on its own texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.textkit import WORD_BYTES, chunks, span_hashes, words

BITS = 18
#: The most training rows of each language, and the most bytes of them.
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 5 << 20
#: Languages that are learned, the most frequent ones; labels are 16-bit.
MOST_LANGUAGES = 256
SWITCH = 6.0
OTHER = -8.0
LEADS = (0.0, 0.5, 1.0, 2.0, 4.0)

LETTERS = WORD_BYTES.copy()
LETTERS[0x30:0x3A] = False

#: Script ranges, as first code point and name (fixed values of the Unicode blocks).
SCRIPTS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other")]
NAMES = sorted({x for _, x in SCRIPTS})
_STARTS = np.array([x for x, _ in SCRIPTS])
_CODES = np.array([NAMES.index(x) for _, x in SCRIPTS])


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages
    uses: np.ndarray  # scripts x languages, boolean
    usual: int = 0
    lead: float = 0.0


def _blank_marks(data: np.ndarray) -> np.ndarray:
    """The bytes with two- and three-byte punctuation (U+0080-00BF but for its letters, U+2000-206F) as spaces."""
    out = data.copy()
    n = len(data)
    two = np.flatnonzero(data == 0xC2)
    two = two[two + 1 < n]
    two = two[~np.isin(data[two + 1], (0xAA, 0xB5, 0xBA))]
    out[two] = out[two + 1] = 32
    three = np.flatnonzero(data == 0xE2)
    three = three[three + 2 < n]
    three = three[(data[three + 1] == 0x80) | ((data[three + 1] == 0x81) & (data[three + 2] < 0xB0))]
    out[three] = out[three + 1] = out[three + 2] = 32
    return out


def _features(off: np.ndarray, data: np.ndarray) -> tuple:
    start, end, first, text = words(off, _blank_marks(data), LETTERS)
    shift = np.uint64(64 - BITS)
    ids = np.stack([span_hashes(text, start, end) >> shift, (span_hashes(text, start, np.minimum(start + 3, end)) * np.uint64(5)) >> shift, (span_hashes(text, np.maximum(start, end - 3), end) * np.uint64(7)) >> shift], 1).astype(np.int32) if len(start) else np.zeros((0, 3), np.int32)
    pad = np.concatenate([text, np.zeros(4, np.uint8)]).astype(np.int64)
    b0, b1, b2, b3 = (pad[start + k] for k in range(4))
    point = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 31) << 6 | b1 & 63, np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63)))
    script = _CODES[np.maximum(np.searchsorted(_STARTS, point, "right") - 1, 0)]
    return ids, first, script, start, end


def train(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    table = np.full((1 << BITS, len(names)), 0.05, np.float64)
    script = np.zeros((len(NAMES), len(names)))
    amount = np.zeros(len(names))
    for k, name in enumerate(names):
        for _, off, data in chunks(pa.array([t for t, x in zip(texts, langs, strict=True) if x == name], pa.large_string())):
            ids, _, s, start, end = _features(off, data)
            for j in range(3):
                table[:, k] += np.bincount(ids[:, j], minlength=1 << BITS)
            script[:, k] += np.bincount(s, minlength=len(NAMES))
            amount[k] += (end - start).sum()
    logp = np.log(table / np.maximum(table.sum(0), 1)) if names else table
    odds = np.clip(logp - logp.mean(1, keepdims=True), -5, 5) if names else logp
    uses = script >= 0.01 * np.maximum(script.sum(0), 1)
    m = Model(names, odds.astype(np.float32), uses, int(amount.argmax()) if names else 0)
    right = np.zeros(len(LEADS))
    for row, off, data in chunks(pa.array(texts, pa.large_string()), 2 << 20) if names else ():
        ids, first, s, start, end = _features(off, data)
        if len(ids):
            size, opening, _, _ = _amounts(m, viterbi(_scores(m, ids, s), first), first, end - start)
            true = np.array([names.index(x) for x in langs[row : row + len(off) - 1]])
            right += [((size + w * opening).argmax(1) == true).sum() for w in LEADS]
    m.lead = LEADS[int(right.argmax())]
    return m


def _amounts(m: Model, path: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bytes of each row in each language, those of its first span, the first words of spans, and each word's row."""
    n, k = len(first) - 1, len(m.languages)
    doc = np.repeat(np.arange(n), np.diff(first))
    new = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])]))
    total = np.bincount(doc * k + path, weights=size, minlength=n * k).reshape(n, k)
    span = np.repeat(np.arange(len(new)), np.diff(np.concatenate([new, [len(path)]])))
    lead = np.concatenate([[True], doc[new][1:] != doc[new][:-1]])[span]
    opening = np.bincount((doc * k + path)[lead], weights=size[lead], minlength=n * k).reshape(n, k)
    return total, opening, new, doc


def _scores(m: Model, ids: np.ndarray, script: np.ndarray) -> np.ndarray:
    s = (m.table[ids[:, 0]] + m.table[ids[:, 1]] + m.table[ids[:, 2]]) / np.float32(3)
    allowed = m.uses[script]
    return np.where(allowed | ~allowed.any(1, keepdims=True), s, np.float32(OTHER))


def viterbi(s: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word of every row. Rows are laid out by time, longest row first,
    so that one step handles a whole chunk of rows."""
    length = np.diff(first)
    rank = np.argsort(-length, kind="stable")
    steps = int(length.max(initial=0))
    if not steps:
        return np.zeros(0, np.int16)
    active = np.searchsorted(-length[rank], -np.arange(steps), "left")
    base = np.concatenate([[0], np.cumsum(active)])
    place = np.empty(len(length), np.int64)
    place[rank] = np.arange(len(length))
    row = np.repeat(np.arange(len(length)), length)
    at = base[np.arange(len(s)) - first[row]] + place[row]
    laid = np.empty_like(s)
    laid[at] = s
    best = np.empty(len(s), np.int16)
    left = np.zeros(s.shape, bool)
    v = laid[: base[1]].copy()
    cuts = base.tolist()
    for t in range(1, steps):
        a, b = cuts[t], cuts[t + 1]
        v = v[: b - a]
        arg = v.argmax(1)
        best[a:b] = arg
        top = v[np.arange(b - a), arg][:, None] - np.float32(switch)
        np.less(v, top, out=left[a:b])
        v = np.maximum(v, top)
        v += laid[a:b]
        # the rows that end at the step before keep their last values in the path below
    path = np.empty(len(s), np.int16)
    final = np.zeros(len(length), np.int16)
    return _trace(laid, best, left, cuts, active, final, path, switch)[at]


def _trace(laid, best, left, cuts, active, final, path, switch) -> np.ndarray:
    """Follow the stored choices back; each row's last label comes from a forward pass over its totals."""
    v = laid[: cuts[1]].copy()
    for t in range(1, len(cuts)):
        a, b = cuts[t - 1], cuts[t]
        nxt = cuts[t + 1] - cuts[t] if t + 1 < len(cuts) else 0
        if nxt < b - a:
            final[nxt : b - a] = v[nxt : b - a].argmax(1)
        if nxt:
            c = cuts[t]
            v = v[:nxt]
            top = v.max(1, keepdims=True) - np.float32(switch)
            v = np.maximum(v, top) + laid[c : c + nxt]
    state = np.zeros(0, np.int64)
    for t in range(len(cuts) - 2, -1, -1):
        a, b = cuts[t], cuts[t + 1]
        if b - a > len(state):
            state = np.concatenate([state, final[len(state) : b - a].astype(np.int64)])
        path[a:b] = state
        if t:
            state = np.where(left[a:b][np.arange(b - a), state], best[a:b], state)
    return path


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """docs with lang_pred, score and spans (start and end bytes and language of each run of words).

    lang_pred is `und` with score 0 if the text is null or has no letter, or no language was learned; a text
    whose letters make no word gets the usual language with score 0. The score is the share of
    letters' bytes in spans of lang_pred. Other columns stay, but those of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "spans", "has_letter_")]
    base = docs.select(*kept, F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("has_letter_"))
    at = kept.index(next(c for c in kept if c.lower() == "text"))
    span = "array<struct<start:long,end:long,lang:string>>"
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("spans", docs.sparkSession.createDataFrame([], f"s {span}").schema[0].dataType)
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            ok = b.column(len(kept)).to_numpy(zero_copy_only=False).astype(bool) & bool(m.languages)
            lang = np.full(len(ok), m.usual)
            score = np.zeros(len(ok))
            marks: list[pa.Array] = []
            counts = np.zeros(len(ok), np.int64)
            for row, off, data in chunks(b.column(at), 2 << 20) if m.languages else ():
                ids, first, script, start, end = _features(off, data)
                if not len(ids):
                    continue
                n = len(off) - 1
                path = viterbi(_scores(m, ids, script), first, switch)
                size, opening, new, doc = _amounts(m, path, first, end - start)
                some = size.sum(1) > 0
                pick = (size + m.lead * opening).argmax(1)
                lang[row : row + n] = np.where(some, pick, m.usual)
                score[row : row + n] = size[np.arange(n), pick] / np.maximum(size.sum(1), 1)
                last = np.concatenate([new[1:], [len(path)]]) - 1
                counts[row : row + n] = np.bincount(doc[new], minlength=n)
                names = pa.array(m.languages)
                marks.append(pa.StructArray.from_arrays([pa.array(start[new] - off[doc[new]]), pa.array(end[last] - off[doc[last]]), names.take(pa.array(path[new].astype(np.int64)))], fields=list(kind)))
            score[~ok] = 0
            flat = pa.concat_arrays(marks) if marks else pa.array([], kind)
            pred = pa.array([*m.languages, "und"]).take(pa.array(np.where(ok, lang, len(m.languages))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pred, pa.array(score), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)], names=[*kept, "lang_pred", "score", "spans"])

    return base.mapInArrow(run, schema)


def held_out(parts: int = 4, at: int = 2):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == at, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, most: int = MOST_LANGUAGES) -> tuple[list[str], list[str]]:
    """Texts and languages of at most `rows` rows and `size` bytes of each of the `most` commonest languages outside the
    held-out fold, in the order of a hash of doc_id. Rows are drawn in one pass: from counts by language follows up to
    which hash a row can be among the first (twice as many as wanted are expected there)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and lang is not null and text is not null").filter(~held_out())
    counts = base.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    if not counts:
        return [], []
    spark = docs.sparkSession
    last = spark.createDataFrame([(r.lang, (1 << 63) - 1 if r.n <= 2 * rows else (2 * rows << 64) // r.n - (1 << 63)) for r in counts], "lang string, last long")
    h = F.xxhash64("doc_id", F.lit(3))
    drawn = base.select("doc_id", "lang", h.alias("h")).join(F.broadcast(last), "lang").filter("h <= last")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ids = spark.createDataFrame([(r.doc_id, r.lang) for r in drawn.withColumn("k", rank).filter(F.col("k") <= rows).collect()], "doc_id long, lang string").distinct()
    found = base.join(F.broadcast(ids), ["doc_id", "lang"])
    total: dict[str, int] = {}
    use = []
    for _, i, name, n in sorted(found.select(F.xxhash64("doc_id", F.lit(4)), "doc_id", "lang", F.octet_length("text")).collect()):
        if total.get(name, 0) + n <= size:
            total[name] = total.get(name, 0) + n
            use.append((i, name))
    keep = spark.createDataFrame(use or [(None, None)], "doc_id long, lang string").distinct()
    got = found.join(F.broadcast(keep), ["doc_id", "lang"]).select("text", "lang").collect()
    return [r[0] for r in got], [r[1] for r in got]


def languages(docs: DataFrame) -> DataFrame:
    """identify() with a model from the rows outside the held-out fold, and held_out."""
    return identify(docs, train(*sample(docs))).withColumn("held_out", held_out())
