"""Very long texts, limits that bind, and plain Python versions of spans, marks and packing."""

import collections
import math
import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import graph, langid, neardup, packing, secrets, sharding, stages, toxicity, workspace
from tests.llm import cases

DOC = "doc_id long, text string"


def plain_entropy(s: str) -> float:
    best = 0.0
    for k in range(len(s) - 19):
        n = collections.Counter(s[k : k + 20])
        best = max(best, -sum(c / 20 * math.log2(c / 20) for c in n.values()))
    return best


def plain_spans(t: str) -> list[tuple]:
    base = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN.replace("(?i:", "(?:(?i:").replace("api_?key)", "api_?key))"), t) if len(m[1]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, t)] + [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, t)]
    out = list(base)
    for m in re.finditer(secrets.CANDIDATE, t):
        s = m[0]
        if any(a <= m.start() and b >= m.end() for a, _, b in base) or not re.search("[0-9]", s) or not re.search("[A-Za-z]", s):
            continue
        if any(re.search(p, s) for p in secrets.ALLOW) or not re.search("[A-Za-z][0-9]|[0-9][A-Za-z]", s):
            continue
        kind = "hex" if re.fullmatch("[0-9A-Fa-f]+", s) else "alnum" if re.fullmatch("[A-Za-z0-9]+", s) else "base64"
        if round(plain_entropy(s), 9) >= secrets.THRESHOLDS[kind]:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def plain_redacted(t: str) -> str:
    out, at, done = [], 0, -1
    for a, _, b in plain_spans(t):
        if a > done:
            out += [t[at:a], "[SECRET]"]
        at = done = max(done, b)
    return "".join([*out, t[at:]])


def test_spans_and_marks_match_plain_python(spark):
    rng = random.Random(31)
    key = lambda n: "".join(rng.choice("abcdefABCDEF0123456789+/_=-xyzXYZ") for _ in range(n))
    bits = [lambda: "token=" + key(12), lambda: "Password: '" + key(9) + "'", lambda: "AKIA" + "".join(rng.choice("ABC123") for _ in range(14)), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(30, 50))), lambda: key(rng.randrange(18, 60)), lambda: "é中𝄞 wörter", lambda: "plain words-and-12-more-words-here", lambda: " "]
    texts = ["".join(rng.choice((" ", "", "\n")) + rng.choice(bits)() for _ in range(n)) for n in (1, 2, 3, 5, 8, 13, 700) for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {r.doc_id: r.spans for r in secrets.digest(df).collect()}
    marked = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    for k, t in enumerate(texts):
        assert got[k] == ",".join(f"{secrets.KINDS[kind]}:{a}:{b}" for a, kind, b in plain_spans(t))
        assert marked[k] == plain_redacted(t)


@pytest.mark.parametrize("text, spans", [("a-1-" * 100_000, 0), ("".join(random.Random(1).choices("ABCDEFabcdef123456789+/wyz", k=1_000_000)), 1), ("token = abcdefgh1 " * 30_000, 30_000), ("token" + " " * 300_000, 0)])
def test_secrets_in_very_long_texts(spark, text, spans):
    df = spark.createDataFrame([(1, text)], DOC)
    r = secrets.digest(df).first()
    assert (r.spans.count(",") + 1 if r.spans else 0) == spans
    assert secrets.redacted(df).first().text.count("[SECRET]") == spans


def test_marks_replace_no_column_of_the_user(spark):
    df = spark.createDataFrame([(1, "token: abcdefghij", 7, "x")], DOC + ", secret_base int, Secret_Spans string")
    assert tuple(secrets.redacted(df).first()) == (1, "[SECRET]", 7, "x")


def test_packing_long_runs_of_one_class(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a" + " " * 1_000_100 + "b", "\n" * 1_200_000, " \t" * 600_000 + "<|endoftext|>" + " " * 20_000, "a" * 300_000, "7" * 300_000, "!" * 300_000]
    got = packing.packed(spark.createDataFrame(list(enumerate(texts)), DOC)).select("doc_id", "start", "ids").collect()
    for k, t in enumerate(texts):
        ids = [x for r in sorted((r for r in got if r.doc_id == k), key=lambda r: r.start) for x in r.ids]
        assert ids == [*tok.encode(t, add_special_tokens=False).ids, 0]


def sequences(got) -> list[list]:
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    return list(by.values())


def test_each_limit_closes_sequences(spark):
    rng = random.Random(33)
    short = spark.createDataFrame([(k, cases.prose(rng, 7)) for k in range(400)], DOC)
    long = spark.createDataFrame([(k, cases.prose(rng, 2000)) for k in range(8)], DOC)
    by_segments = sequences(packing.packed(short, segments=20).collect())
    assert sum(len(s) == 20 and sum(r.length for r in s) < 1024 for s in by_segments) >= len(by_segments) - 4
    by_loss = sequences(packing.packed(long).collect())  # with the limits of production
    full = [s for s in by_loss if sum(r.loss for r in s) == packing.MAX_LOSS]
    assert any(sum(r.length for r in s) < packing.MAX_TOKENS for s in full) and len(full) >= len(by_loss) - 4
    by_tokens = sequences(packing.packed(short).collect())
    assert any(sum(r.length for r in s) == packing.MAX_TOKENS and len(s) < packing.MAX_SEGMENTS and sum(r.loss for r in s) < packing.MAX_LOSS for s in by_tokens)


def test_prompts_bear_no_loss(spark):
    rng = random.Random(34)
    data = []
    for k in range(60):
        head, tail = "Frage é " + cases.prose(rng, rng.randrange(60)), cases.prose(rng, rng.randrange(1, 200))
        data.append((k, head + " " + tail, rng.choice([None, -3, 0, len(head), 10**6])))
    got = packing.packed(spark.createDataFrame(data, DOC + ", head int"), tokens=300, segments=5, loss=200, prompt="head").collect()
    enc = packing.encoder()
    for k, t, head in data:
        ids = [*enc.encode(t, allowed_special="all"), 0]
        n = len(enc.encode((t[:head] if (head or 0) > 0 else "")))
        starts = np.cumsum([0] + [len(enc.decode_single_token_bytes(i)) for i in ids[:-1]])
        free = int((starts[: len(ids) - 1] < len(t[: max(head or 0, 0)].encode())).sum())
        assert abs(free - n) <= 1
        for r in (r for r in got if r.doc_id == k):
            assert r.loss == sum(1 for j in range(r.start, r.start + r.length) if j > r.start and j >= free)
    for s in sequences(got):
        assert sum(r.length for r in s) <= 300 and len(s) <= 5 and sum(r.loss for r in s) <= 200
    assert sum(r.length for r in got) == sum(len(enc.encode(t)) + 1 for _, t, _ in data)


def test_more_than_127_languages(spark):
    texts = [" ".join(f"l{k}w{j}x" for j in range(8)) for k in range(150)]
    words = lambda k: " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}{c * 3}" for c in "bcdfghjk")
    texts = [words(k) for k in range(150)]
    model = langid.train(texts, [f"l{k:03d}" for k in range(150)])
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), DOC), model).collect()}
    assert all(got[k].lang_pred == f"l{k:03d}" and got[k].spans[0].lang == f"l{k:03d}" for k in range(150))


def test_language_sample_is_bounded_by_hash_order(spark):
    rows = [(k, f"word{k} of it", "ab"[k % 7 == 0]) for k in range(3000)]
    texts, langs = langid.sample(spark.createDataFrame(rows, DOC + ", lang string"), rows=50)
    assert collections.Counter(langs) == {"a": 50, "b": 50} and len(set(texts)) == 100
    assert langid.sample(spark.createDataFrame(rows, DOC + ", lang string"), rows=50, most=1)[1] == ["a"] * 50


def test_training_adds_to_the_weights_from_which_it_starts():
    rng = random.Random(35)
    good, bad = [f"g{k}" for k in range(20)], [f"b{k}" for k in range(20)]

    def row(toxic: bool) -> str:
        # toxic is a pair of words that both occur as often in clean texts, apart
        w = cases.prose(rng, 12).split(" ")
        a, b = rng.choice(good), rng.choice(bad)
        w[3:3] = [a, b] if toxic else [a, "and", "then", b]
        return " ".join(w)

    y = np.array([k % 2 for k in range(1200)])
    texts = [row(bool(v)) for v in y]
    import pyarrow as pa

    def right(epochs: int, steps: int) -> float:
        old, toxicity.STEPS = toxicity.STEPS, steps
        try:
            m = toxicity.train(texts[:900], y[:900], ["en"] * 900, epochs=epochs)
        finally:
            toxicity.STEPS = old
        s, _ = toxicity.scores(m, pa.array(texts[900:]))
        return float(((s >= 0.5) == y[900:]).mean())

    assert right(30, 400) > right(0, 0) + 0.15


def test_training_leaves_the_driver_room(monkeypatch):
    rng = random.Random(37)
    words = [f"w{k}" for k in range(30000)]
    texts = [" ".join(rng.choices(words, k=170)) for _ in range(6000)]
    monkeypatch.setattr(toxicity, "STEPS", 0)
    tracemalloc.start()
    toxicity.train(texts, np.arange(6000) % 2, [f"l{k % 8}" for k in range(6000)], epochs=0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 95e6  # 108 MB with whole tables beside their copies


def test_tables_leave_few_shuffles_in_the_driver(spark, monkeypatch):
    monkeypatch.setattr(workspace, "SETTLE_SECONDS", 0, raising=False)
    monkeypatch.setattr(workspace, "SETTLE_SHARE", 0, raising=False)
    shuffles = lambda: set(map(str, spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().keySet())))
    before = shuffles()
    for k in range(3):
        workspace.stored(spark.range(1000).groupBy((F.col("id") % 97 + k).alias("g")).count(), "counted")
    until = time.time() + 20
    while len(shuffles() - before) > 1 and time.time() < until:
        time.sleep(0.2)
    assert len(shuffles() - before) <= 1  # the last one's job may still be told of when the driver settles


def test_sharding_subdivides_overfull_ranges(spark, monkeypatch):
    rng = random.Random(36)
    hot = "the same text"
    data = [(k % 50 if k < 300 else k, hot if k < 900 else cases.prose(rng, rng.randrange(1, 30))) for k in range(1800)] + [(None, hot)] * 100
    turns = []
    real = sharding._ranged
    monkeypatch.setattr(sharding, "_ranged", lambda rows, splitters: turns.append(len(splitters)) or real(rows, splitters))
    got = sharding.sharded(spark.createDataFrame(data, DOC).repartition(5), ranges=16).collect()
    assert len(turns) > 1 and turns[-1] > turns[0]  # ranges were divided
    size, slots, order = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        order[r.text_crc32].add(r.shard)
    assert len(got) == len(data) and sorted(size) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(size.values())
    assert all(abs(s - total / 16) <= max(r.size for r in got) for s in size.values())
    assert all(max(s) - min(s) == len(s) - 1 for s in order.values())  # equal texts lie together


def test_duplicate_rows_with_a_map(spark, sf_dir):
    df = spark.sql("select 1L as doc_id, 'one two three four five six' as text, map('a', 1) as m union all select 1L, 'one two three four five six', map('b', 2) union all select 2L, 'x', map('c', 3)")
    assert sorted(r.doc_id for r in stages.deduplicated(spark, df, sf_dir).collect()) == [1, 2]


def test_near_duplicates_over_many_rounds(spark, monkeypatch):
    rng = random.Random(40)
    data, base = [], [f"b{k}" for k in range(60)]
    for k in range(50):  # copies of one text with a few changes each, so that many pairs are just alike and many just not
        w = list(base)
        for j in rng.sample(range(60), rng.randrange(3)):
            w[j] = f"n{k}_{j}"
        data.append((900 - k, " ".join(w), None, None, None, None, None, None))
    want = cases.components(data)
    assert 1 < len(set(want.values())) < 50
    rounds = []
    real = neardup._labelled
    monkeypatch.setattr(neardup, "PAIRS_PER_ROW", 0)
    monkeypatch.setattr(neardup, "_labelled", lambda lists, comp: rounds.append(comp) or real(lists, comp))
    got = neardup.near_duplicates(cases.table(spark, data)).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(rounds) > 2


def test_a_large_group_of_near_copies_takes_two_rounds(spark, monkeypatch):
    rng = random.Random(41)
    data, base = [], [f"b{k}" for k in range(60)]
    for k in range(200):
        w = list(base)
        for j in rng.sample(range(60), rng.randrange(4)):
            w[j] = f"n{k}_{j}"
        data.append((9000 - k, " ".join(w), None, None, None, None, None, None))
    rounds = []
    real = neardup._labelled
    monkeypatch.setattr(neardup, "_labelled", lambda lists, comp: rounds.append(comp) or real(lists, comp))
    got = neardup.near_duplicates(cases.table(spark, data)).collect()
    assert {r.doc_id: r.component_id for r in got} == cases.components(data) and len(rounds) == 2


def test_short_and_long_edge_tables_have_equal_components(spark, monkeypatch):
    rng = random.Random(42)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(5, 5), (None, 3), (-7, 299)]
    df = spark.createDataFrame(edges, "u long, v long")
    short = sorted(map(tuple, graph.components(df).collect()))
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    assert short and short == sorted(map(tuple, graph.components(df).collect()))
    assert graph.components(df.limit(0)).count() == 0
