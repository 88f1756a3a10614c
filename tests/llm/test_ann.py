import numpy as np

from gridloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    rows = [(k, [float(v) for v in x[k]], 1) for k in range(900)]
    rows[7] = (7, None, 1)
    rows[8] = (8, [0.0] * 16, 1)
    rows[9] = (9, [float("nan")] + [1.0] * 15, 1)
    rows[10] = (10, [None] + [1.0] * 15, 1)
    rows[11] = (11, [1.0, 2.0], 1)
    rows[12] = (12, [float("inf")] + [1.0] * 15, 1)
    for k in range(600, 640):
        rows[k] = (k, rows[600][1], 1)
    rows += [rows[50], (None, rows[3][1], 1)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    real = {k: np.float32(v).astype(float) for k, v, _ in rows if k is not None and not 7 <= k <= 12}
    ids = np.array(sorted(real))
    m = np.stack([real[i] for i in ids])
    hit = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == {int(i) for i in ids if i % 20 == 0}
    for q, found in by.items():
        s = (m * real[q]).cumsum(1)[:, -1]
        s[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(score == s[ids == i][0] for _, i, score in found)
        assert [(-score, i) for _, i, score in found] == sorted((-score, i) for _, i, score in found)
        hit += len(set(want.tolist()) & {i for _, i, _ in found})
    assert hit / (20 * len(by)) >= 0.9


def test_small_and_empty(spark):
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)], SCHEMA)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in few) == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.nearest(spark.createDataFrame([(20, [1.0], 1)], SCHEMA)).count() == 0


def recall(got, x, k=20):
    by = {}
    for r in got:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in by.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found & set(np.lexsort((np.arange(len(x)), -s))[:k].tolist()))
    assert set(by) == set(range(0, len(x), 20)) and all(len(f) == k for f in by.values())
    return hit / (k * len(by))


def test_parts_of_parts_and_blocks(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16))
    x = np.float32(centres[rng.integers(0, 40, 4000)] + 0.6 * rng.normal(size=(4000, 16))).astype(float)
    rows = spark.createDataFrame([(k, [float(v) for v in x[k]], 1) for k in range(4000)], SCHEMA)
    shares = [recall(ann.nearest(rows, parts=4, block_rows=b, block_queries=q).collect(), x) for b, q in ((50_000, 10_000), (300, 40))]  # one level, and two
    assert min(shares) >= 0.9, shares


def test_queries_with_too_few_candidates_search_all_parts(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 8))
    x[0:300:20] *= 5
    real = ann.fit

    def one_probe(*args, **kwargs):
        router = real(*args, **kwargs)
        router.probes = 1
        return router

    monkeypatch.setattr(ann, "fit", one_probe)
    rows = spark.createDataFrame([(k, [float(v) for v in x[k]], 1) for k in range(300)], SCHEMA)
    got = ann.nearest(rows, parts=16).collect()
    assert {r.query_id for r in got} == set(range(0, 300, 20)) and len(got) == 15 * 20
