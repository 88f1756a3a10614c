"""Vector bin packing of token sequences.

Each example asks for tokens, one segment and loss-bearing tokens: those of a piece but its first, which
nothing precedes, and but those of a prompt, if the examples have one. A sequence has a limit on each. The next piece
of a sequence is the one whose demand has the largest dot product with what is left, both as shares of the
limits; when none fits whole, the one that fills most of the gap is cut. A limit that is used up closes the sequence.
Packing runs inside each partition over a bounded pool, so nothing is shuffled and memory doesn't grow; each
partition ends with at most one short sequence beyond those that a limit other than tokens closed.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.textkit import release

MAX_TOKENS = 1024
MAX_SEGMENTS = 128
#: Four less than the tokens: a sequence of fewer than four pieces of plain text is closed by it.
MAX_LOSS = 1020
POOL = 512
END_ID = 0
#: The tokenizer's pattern backtracks over white space, and gives up on a run of a million; runs from here on go to it apart.
LONG_BLANK = re.compile("[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
SPECIAL = "<|endoftext|>"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss long"


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """Byte-level BPE from a file of ranks. The same vocabulary as byte_bpe_50k.json, with the same ids;
    its special token's string is taken as that token, as the tokenizers library does by default."""
    import public_tokenizers as P
    import tiktoken

    with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


@lru_cache(maxsize=2)
def token_bytes(path: str | None = None) -> np.ndarray:
    """Bytes of each token."""
    enc = encoder(path)
    return np.array([len(enc.decode_single_token_bytes(k)) for k in range(enc.n_vocab)], np.int64)


def encoded(text: str, path: str | None = None) -> np.ndarray:
    """Ids of text. A long run of white space is a piece of its own, but for its last character if others follow."""
    enc, parts, at = encoder(path), [], 0
    for m in LONG_BLANK.finditer(text):
        end = m.end() if m.end() == len(text) or text.startswith(SPECIAL, m.end()) else m.end() - 1
        parts.append(enc.encode_to_numpy(text[at : m.start()], allowed_special="all"))
        parts.append(np.array(enc._core_bpe.encode_single_piece(text[m.start() : end].encode()), np.uint32))
        at = end
    last = enc.encode_to_numpy(text[at:], allowed_special="all") if at < len(text) else np.zeros(0, np.uint32)
    return np.concatenate([*parts, last]) if parts else last


class Packer:
    """Packs pieces of documents into sequences; emit(key, start, ids, total, sequence, offset, loss)."""

    def __init__(self, emit, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS, pool: int = POOL):
        if tokens < 1 or segments < 1 or loss < 1:
            raise ValueError("limits must be 1 at least")
        self.emit, self.caps, self.size = emit, np.array([tokens, segments, loss]), pool
        self.items: list[tuple] = []
        self.lengths = np.zeros(pool + 1, np.int64)
        self.free = np.zeros(pool + 1, np.int64)  # tokens at the head of a piece that bear no loss
        self.sequence = 0

    def add(self, key, ids: np.ndarray, prompt: int = 0) -> None:
        """The document's ids, of which the first `prompt` bear no loss."""
        total, at = len(ids), 0
        while at < total:
            free = max(1, prompt - at)
            most = int(min(self.caps[0], free + self.caps[2]))
            if total - at < most:
                self._put(len(self.items), (key, ids[at:], at, total, prompt))
                if len(self.items) > self.size:
                    self.fill()
                return
            self.emit(key, at, ids[at : at + most], total, self.sequence, 0, max(0, most - free))
            self.sequence += 1
            at += most

    def _put(self, i: int, item: tuple) -> None:
        self.items[i : i + 1] = [item]
        self.lengths[i], self.free[i] = len(item[1]), max(1, item[4] - item[2])

    def _take(self, i: int, n: int, offset: int) -> int:
        """Place n tokens of piece i; how many of them bear loss."""
        key, ids, start, total, prompt = self.items[i]
        loss = max(0, n - int(self.free[i]))
        self.emit(key, start, ids[:n], total, self.sequence, offset, loss)
        if n < len(ids):
            self._put(i, (key, ids[n:], start + n, total, prompt))
        else:
            last = self.items.pop()
            if i < len(self.items):
                self._put(i, last)
        return loss

    def fill(self) -> None:
        """One sequence from the pool."""
        left, offset = self.caps.copy(), 0
        while self.items and left.min() >= 1:
            n, free = self.lengths[: len(self.items)], self.free[: len(self.items)]
            loss = np.maximum(n - free, 0)
            share = left / self.caps**2.0
            whole = (n <= left[0]) & (loss <= left[2])
            if whole.any():
                i = int(np.where(whole, n * share[0] + share[1] + loss * share[2], -1).argmax())
                size = int(n[i])
            else:
                fits = np.minimum(np.minimum(n, left[0]), free + left[2])
                i = int(fits.argmax())
                size = int(fits[i])
            left -= (size, 1, self._take(i, size, offset))
            offset += size
        self.sequence += 1

    def close(self) -> None:
        while self.items:
            self.fill()


def packed(docs: DataFrame, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS, vocabulary: str | None = None, prompt: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss (its loss-bearing
    tokens), and the ids themselves. A null or empty text is the closing id alone; rows of one doc_id are separate
    documents; sequence_id is unique over the result.

    prompt names a column with the number of characters at the head of a text that bear no loss (null or below 0: none; beyond
    the text: all of it, then only the closing id bears loss). A token that begins in the prompt belongs to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        packer = Packer(lambda key, start, ids, total, seq, off, bears: out.append((key, start, len(ids), zlib.crc32(ids.tobytes()), total, base + seq, off, bears, ids)), tokens, segments, loss)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cols[2])]).astype(np.int32)), pa.array(np.concatenate(cols[8]).astype(np.int32)))
            rec = pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:8]], ids], names=[*[x.split()[0] for x in SCHEMA.split(", ")], "ids"])
            out.clear()
            return rec

        for b in batches:
            for key, text, head in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                text = text.as_py()
                ids = encoded(text, vocabulary) if text else np.zeros(0, np.uint32)
                first = 0
                if head and head > 0 and len(ids):
                    starts = np.cumsum(token_bytes(vocabulary)[ids]) - token_bytes(vocabulary)[ids]
                    first = int(np.searchsorted(starts, len(text[:head].encode()), "left"))
                packer.add(key, np.append(ids, np.uint32(END_ID)).astype("<u4"), first)
                if len(out) >= 1024:
                    yield flush()
            release()
        packer.close()
        if out:
            yield flush()

    head = F.col(prompt).cast("long") if prompt else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), head.alias("head")).mapInArrow(run, SCHEMA + ", ids array<int>")
