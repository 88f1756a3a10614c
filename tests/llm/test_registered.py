"""The registered queries over a whole small table: against SQL where there is some, else against plain Python."""

import collections
import zlib

import duckdb
import numpy as np
import pytest

from gridloom.llm import catalog, stages
from tests.llm import cases
from tests.test_queries import plain


@pytest.fixture(scope="module")
def docs(sf_dir):
    return duckdb.sql(f"select doc_id, text, lang from '{sf_dir}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf_dir)
    want = con.sql(catalog.oracle_sql()[name])
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(want.columns) == sorted(df.columns)
    assert plain(df.select(sorted(df.columns)).collect()) == plain([tuple(r[i] for i in at) for r in want.fetchall()])


def test_op10(spark, sf_dir, docs):
    got = catalog.op10_repeats(spark, sf_dir)
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(cases.kept_bytes(docs, 200))


def token_check(texts: dict, got) -> None:
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(by) == set(texts)
    for i, t in texts.items():
        ids, at = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 1024 * 4


def test_op3(spark, sf_dir, docs):
    token_check({i: t for i, t, _ in docs}, catalog.op3_packing(spark, sf_dir).collect())


def test_op4(spark, sf_dir, docs):
    lang = {i: x for i, _, x in docs}
    got = catalog.op4_langid(spark, sf_dir).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op1(spark, sf_dir):
    y = dict(duckdb.sql(f"select doc_id, toxic from '{sf_dir}/labels.parquet'").fetchall())
    got = catalog.op1_toxicity(spark, sf_dir).collect()
    seen = [r for r in got if r.doc_id in y and not r.held_out]
    held = [r for r in got if r.doc_id in y and r.held_out]
    assert sum(r.predicted == y[r.doc_id] for r in seen) >= 0.95 * len(seen)
    assert sum(r.predicted == y[r.doc_id] for r in held) >= 0.85 * len(held)


def test_op6(spark, sf_dir, docs):
    got = catalog.op6_sharding(spark, sf_dir).collect()
    raw = {i: (t or "").encode() for i, t, _ in docs}
    size = collections.Counter()
    for r in got:
        assert r.size == len(raw[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(raw[r.doc_id])
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in got)


def test_op9(spark, sf_dir):
    v = duckdb.sql(f"select vec_id, embedding from '{sf_dir}/embeddings.parquet' order by 1").fetchall()
    ids, m = np.array([x[0] for x in v]), np.array([x[1] for x in v], float)
    by = collections.defaultdict(set)
    for r in catalog.op9_ann(spark, sf_dir).collect():
        by[r.query_id].add(r.vec_id)
    hit = 0
    for q in ids[ids % 20 == 0]:
        s = m @ m[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(by[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hit >= 0.9 * 20 * len(by)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "neardup", "decontamination", "secrets", "packing"]
    left = [tuple(r) for r in stages.clean(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).select("doc_id", "text").collect()]
    whole = {i: c for i, c in cases.components(left).items() if i == c}
    left = [r for r in left if r[0] in whole]
    items = duckdb.sql(f"select item_id, text from '{sf_dir}/benchmark.parquet'").fetchall()
    bad = {r[0] for r in cases.contaminated(left, items) if r[5]}
    left = [r for r in left if r[0] not in bad]
    clean = stages.without_secrets(spark, spark.createDataFrame(left, "doc_id long, text string"), sf_dir).collect()
    assert all("[SECRET]" in r.text or r.text == dict(left)[r.doc_id] for r in clean)
    token_check({r.doc_id: r.text for r in clean}, corpus_pipeline.run(spark, sf_dir).collect())
