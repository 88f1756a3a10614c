import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import decontam, langid, licenses, neardup, packing, repeats, secrets, sharding, stages, textkit, toxicity
from tests.llm import cases


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_words_and_shingles_match_plain_python():
    texts = [r[1] for r in cases.documents()]
    got = list(textkit.shingle_sets(pa.array(texts)))
    assert [len(x) for x in got] == [len(cases.shingle_set(t)) for t in texts]
    sliced = list(textkit.shingle_sets(pa.array(["skip", *texts])[1:]))
    assert all((a == b).all() for a, b in zip(got, sliced, strict=True))


def test_near_duplicates(spark):
    data = cases.documents()
    want = cases.components(data)
    got = neardup.near_duplicates(cases.table(spark)).collect()
    assert len(got) == len(data)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
    assert neardup.near_duplicates(cases.empty(spark)).count() == 0


def test_one_doc_id_on_different_texts(spark, sf_dir):
    rng = random.Random(21)
    texts = [cases.prose(rng, 80, 5000) for _ in range(8)]
    other = lambda t, k: t.replace(t.split(" ")[40], f"new{k}")
    data = [(5, texts[0]), (5, texts[1]), (7, other(texts[0], 1)), (8, other(texts[1], 2)), (3, texts[2]), (9, texts[2]), (3, texts[3]), (6, other(texts[2], 3)), (2, other(texts[3], 4)), (20, texts[4]), (21, other(texts[4], 5)), (21, texts[5]), (30, texts[6]), (30, other(texts[6], 6)), (31, None), (31, texts[7])]
    data = [(*r, None, None, None, None, None, None) for r in data]
    want = cases.components(data)
    docs = cases.table(spark, data)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(data) and {r.doc_id: r.component_id for r in got} == want
    kept = sorted(((r.doc_id, r.text) for r in stages.deduplicated(spark, docs, sf_dir).collect()), key=repr)
    sure = [(5, texts[0]), (5, texts[1]), (3, texts[2]), (2, other(texts[3], 4)), (20, texts[4]), (21, texts[5]), (31, None), (31, texts[7])]
    assert [r for r in kept if r[0] != 30] == sorted(sure, key=repr) and sum(r[0] == 30 for r in kept) == 1


def test_near_duplicates_chain_of_copies(spark):
    rng = random.Random(5)
    base, data = cases.prose(rng, 200, 5000).split(" "), []
    for k in range(60):
        base[rng.randrange(200)] = f"n{k}"
        data.append((1000 - k, " ".join(base), None, None, None, None, None, None))
        for j in range(2):
            other = list(base)
            for _ in range(12):
                other[rng.randrange(200)] = f"m{k}_{j}_{rng.random()}"
            data.append((2000 + 2 * k + j, " ".join(other), None, None, None, None, None, None))
    want = cases.components(data)
    got = neardup.near_duplicates(cases.table(spark, data)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_repeats(spark):
    data = cases.documents()
    got = rows(repeats.without_repeats(cases.table(spark), 200, 64), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(cases.kept_bytes(data, 200), key=repr)
    assert repeats.without_repeats(cases.empty(spark)).count() == 0


def test_repeats_in_mixed_text_and_hot_anchors(spark, monkeypatch):
    rng = random.Random(2)
    passage = cases.prose(rng, 70)
    data = []
    for k in range(40):
        left, right = cases.prose(rng, rng.randrange(40)), cases.prose(rng, rng.randrange(40))
        data.append((k, f"{left} é {passage[rng.randrange(60):]} {right}", None, None, None, None, None, None))
    want = sorted(cases.kept_bytes(data, 200), key=repr)
    for most in (20_000, 3):
        monkeypatch.setattr(repeats, "HOT", most)
        got = rows(repeats.without_repeats(cases.table(spark, data)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == want


def test_matching_is_the_longest_match_elsewhere():
    rng = random.Random(4)
    for _ in range(60):
        t = bytes(rng.choice(b"ab\xff" if rng.random() < 0.5 else b"abcd") for _ in range(rng.randrange(1, 60)))
        got = repeats.matching(np.frombuffer(t, np.uint8))
        for i in range(len(t)):
            best = max((next((k for k in range(len(t)) if i + k >= len(t) or j + k >= len(t) or t[i + k] != t[j + k]), 0) for j in range(len(t)) if j != i), default=0)
            assert got[i] == best


def test_contamination(spark):
    rng = random.Random(3)
    items = [(1, cases.prose(rng, 30)), (2, "short item here"), (3, None), (4, ""), (2, cases.prose(rng, 13)), (5, " ".join(["same"] * 20))]
    data = cases.documents()
    extra = ["Short ITEM, here!", "x " + items[0][1][20:130] + " y", items[4][1], "same " * 15, "x " * 500 + "short item here", None]
    data += [(100 + k, t, None, None, None, None, None, None) for k, t in enumerate(extra)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontam.contamination(cases.table(spark, data), bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(cases.contaminated(data, items), key=repr)
    assert decontam.contamination(cases.empty(spark), bench).count() == 0
    none = decontam.contamination(cases.table(spark), bench.limit(0))
    assert none.filter("contaminated").count() == 0 and none.count() == len(cases.documents())


def test_proximity_matches_allow_changed_words(spark):
    rng = random.Random(8)
    item = cases.prose(rng, 20, 5000)
    words = item.split(" ")
    words[6] = "changed"
    met, _ = decontam.matches(cases.table(spark, [(1, "a b " + " ".join(words), None, None, None, None, None, None)]), spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = met.collect()
    assert {r.pos for r in got if r.close} == {2 + k for k in range(20) if k != 6}
    assert {r.pos for r in got if r.exact} == {2 + k for k in range(7, 20)}


def test_proximity_matches_without_the_rarest_word(spark):
    rng = random.Random(12)
    items = [(k, cases.prose(rng, n, 60)) for k, n in enumerate((13, 13, 40, 12, 10, 5, 1))]
    items[0] = (0, "rarest " + items[0][1][5:])
    schema = "item_id long, text string"
    split = [t.split(" ") for _, t in items]
    data = [(1, " ".join(["a", "changed", *split[0][1:], "b"])), (2, "rarest"), (3, cases.prose(rng, 400, 60))]
    for k in range(60):  # up to five words changed, to words in or out of the corpus, or cut out
        w = list(split[k % 6])
        for j in rng.sample(range(len(w)), min(len(w), k // 6 % 6)):
            w[j] = rng.choice((f"w{rng.randrange(60):03d}", f"new{k}", ""))
        data.append((10 + k, cases.prose(rng, 5, 60) + " " + " ".join(w) + " " + cases.prose(rng, 5, 60)))
    want = {}
    for i, t in data:
        w, hit, found = t.split(), set(), set()
        for name, x in enumerate(split):
            length, agree = min(13, len(x)), min(10, len(x))
            for a in range(len(x) - length + 1):
                for at in range(-length + 1, len(w)):
                    same = [at + j for j in range(length) if 0 <= at + j < len(w) and w[at + j] == x[a + j]]
                    if len(same) >= agree:
                        hit.update(same)
                        found.add(name)
        want[i] = (len(hit), len(found), hashlib.sha256(",".join(map(str, sorted(found))).encode()).hexdigest())
    assert want[1][0] >= 12
    docs, bench = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, schema)
    got = decontam.contamination(docs, bench, near=decontam.NEAR).collect()
    assert {r.doc_id: (r.n_near, r.n_near_items, r.near_items_sha256) for r in got} == want
    plain = rows(decontam.contamination(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert plain == sorted(cases.contaminated(data, items), key=repr) == sorted((tuple(r)[:6] for r in got), key=repr)


def test_secrets(spark):
    texts = ["password: abcdefgh", "PassWord=short token=secret: abcdefghij", "AKIAABCDEFGHIJKL AKIASHORT", "é api_key='ABCDEFGH.ijk'", "f" * 31 + " " + "f" * 32, "key q9ZxK2mP7vLw4RtY8sB1 end", "id 123e4567-e89b-12d3-a456-426614174000", None, "", "section-12-of-34-and-more-words"]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, base int, spans int")
    got = {r.doc_id: r for r in secrets.digest(df).collect()}
    assert got[0].spans == "assign:0:18" and got[0].n_assign == 1
    assert got[1].spans == ""  # the second match is consumed by the first one's value
    assert got[2].spans == "access:0:16" and got[2].n_access == 1
    assert got[3].spans == "assign:2:23"
    assert got[4].spans == "hex:32:64" and got[4].n_hex == 1
    assert got[5].spans == "entropy:4:24"
    assert got[6].spans == got[7].spans == got[8].spans == got[9].spans == ""
    clean = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    assert clean[0] == "[SECRET]" and clean[5] == "key [SECRET] end" and clean[7] is None and clean[3] == "é [SECRET]'"
    assert secrets.digest(cases.empty(spark)).count() == 0


def test_window_entropy_by_counts(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    s = ["".join(rng.choice("abcdef0123456789+/_=-XYZ") for _ in range(n)) for n in (1, 19, 20, 21, 45)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in s], "s string").select(secrets.peak_entropy(F.col("s"))).collect()]

    def plain(x):
        out = [0.0]
        for k in range(len(x) - 19):
            c = np.unique(list(x[k : k + 20]), return_counts=True)[1] / 20
            out.append(float(-(c * np.log2(c)).sum()))
        return max(out)

    assert np.allclose(got, [plain(x) for x in s])


def test_licenses(spark):
    rng = random.Random(6)
    grant = licenses.TEMPLATES["mit-grant"]
    data = [(1, "text " + grant + " more"), (2, cases.prose(rng, 50) + "\nLicensed under CC BY-NC 4.0."), (3, grant.replace("free of charge", "without any fee")), (4, "License free text"), (5, None), (6, "")]
    got = {r.doc_id: r for r in licenses.licensed(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1].licenses == "mit-grant" and got[1].best == 1.0
    assert got[2].licenses == "cc-by-nc-4.0-line"
    assert got[3].licenses == ("mit-grant" if got[3].best >= 0.75 else "")
    assert got[4].n_licenses == got[5].n_licenses == got[6].n_licenses == 0
    assert licenses.licensed(cases.empty(spark)).count() == 0
    assert licenses.licensed(cases.table(spark)).count() == len(cases.documents())


def test_packing(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    data = cases.documents() + [(500, "<|endoftext|> x", None, None, None, None, None, None)]
    data = [(k, *r[1:]) for k, r in enumerate(data)]
    got = packing.packed(cases.table(spark, data)).collect()
    for k, r in enumerate(data):
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((p for p in got if p.doc_id == k), key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids)
        for p in own:
            part = ids[p.start : p.start + p.length]
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(part.tobytes()) and list(part) == p.ids
    check_sequences(got, 1024, 128, 1024)
    assert packing.packed(cases.empty(spark)).count() == 0


def check_sequences(got, tokens, segments, loss):
    by = {}
    for p in got:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= tokens and len(parts) <= segments and at - len(parts) <= loss


@pytest.mark.parametrize("limits", [(64, 3, 50), (32, 100, 20), (100, 1, 99)])
def test_packing_keeps_all_limits(spark, limits):
    check_sequences(packing.packed(cases.table(spark), *limits).collect(), *limits)


def test_languages_and_viterbi(spark):
    rng = np.random.default_rng(1)
    for _ in range(40):
        lens = rng.integers(0, 6, 4)
        first = np.concatenate([[0], np.cumsum(lens)])
        s = rng.normal(0, 3, (first[-1], 3)).astype(np.float32)
        path = langid.viterbi(s, first, 2.0)
        for a, b in zip(first[:-1], first[1:], strict=True):
            value = lambda q: sum(s[a + t, q[t]] for t in range(b - a)) - 2 * sum(q[t] != q[t - 1] for t in range(1, b - a))  # noqa: B023, E731
            if b > a:
                assert abs(max(map(value, itertools.product(range(3), repeat=b - a))) - value(path[a:b])) < 1e-4
    en, ru = "the cat sat on the mat and the dog ran", "кошка сидела на ковре и собака бежала"
    model = langid.train([en, ru, "le chat est sur le tapis et le chien court"] * 3, ["en", "ru", "fr"] * 3)
    data = [(1, en), (2, ru), (3, en + ". " + ru + "."), (4, None), (5, "123 … !"), (6, ""), (7, "ª")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(data, "doc_id long, text string"), model).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "ru"
    assert [s.lang for s in got[3].spans] == ["en", "ru"] and got[3].spans[1].start == len(en) + 2
    assert [got[k].lang_pred for k in (4, 5, 6)] == ["und"] * 3 and got[7].lang_pred in ("en", "fr", "ru", "und")
    assert langid.languages(cases.table(spark)).count() == len(cases.documents())
    assert langid.languages(cases.empty(spark)).count() == 0


def test_toxicity(spark):
    rng = random.Random(9)
    data, labels = [], []
    for k in range(300):
        text = cases.prose(rng, rng.randrange(5, 60))
        bad = k % 3 == 0
        if bad:
            text = text + " vile" + rng.choice("abcdefgh") + " " + cases.prose(rng, 5)
        data.append((k, text, "en", None, None, None, None, None))
        labels.append((k, int(bad)))
    docs, lab = cases.table(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, lab).collect()
    held = [r for r in got if r.held_out]
    right = sum(r.predicted == int(r.doc_id % 3 == 0) for r in held)
    assert held and right / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    odd = toxicity.toxicity(cases.table(spark), lab)
    assert odd.count() == len(cases.documents()) and odd.columns.count("score") == 1
    assert toxicity.toxicity(cases.empty(spark), lab).count() == 0
    assert toxicity.toxicity(cases.table(spark), lab.limit(0)).filter("predicted = 1").count() == 0


def test_sharding(spark):
    data = [(k, r[1], *r[2:]) for k, r in enumerate(cases.documents() * 30)]
    got = sharding.sharded(cases.table(spark, data)).collect()
    texts = {r[0]: (r[1] or "").encode() for r in data}
    size, slots = {}, {}
    for r in got:
        assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "bytes" and r.grown_shard is None
        size[r.shard] = size.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(data) and set(size) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in got)
    assert sharding.sharded(cases.empty(spark)).count() == 0
    same = sharding.sharded(cases.table(spark, [data[6]] * 200 + [(None, None, *data[0][2:])])).collect()
    assert len(same) == 201 and {r.shard for r in same} == set(range(16))


def test_stages_keep_columns_and_handle_odd_rows(spark, sf_dir):
    docs = cases.table(spark)
    for stage in (stages.clean, stages.deduplicated, stages.decontaminated, stages.without_secrets):
        for df in (docs, cases.empty(spark)):
            out = stage(spark, df, sf_dir)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert all(r.spans == "clash" or r.doc_id is None for r in out.collect())
    kept = stages.deduplicated(spark, docs, sf_dir).collect()
    want = cases.components(cases.documents())
    ids = sorted(r.doc_id for r in kept if r.doc_id is not None)
    assert ids == sorted({i for i, c in want.items() if i == c})
    assert sum(r.doc_id is None for r in kept) == 2
    assert stages.sequences(spark, cases.empty(spark), sf_dir).count() == 0
