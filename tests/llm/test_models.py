"""op5, op9, op10: exact figures, gradients, held-out accuracy, edge cases."""

import math
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.llm import katz, lang_gru, queries, toxicity
from vexel.llm.session import held_out


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = lang_gru.new_net(["a", "b", "c"], 3, rng)
    for p in ("x", "u", "out", "bias"):
        setattr(net, p, getattr(net, p).astype(np.float64))
    data, y = rng.integers(97, 103, (7, 4)), np.array([0, 1, 2, 1])

    def loss():
        p = lang_gru.position_probs(net, data)
        return -np.log(p[:, y, np.arange(4)]).sum()

    tapes = []
    d = lang_gru.position_probs(net, data, tapes)
    ahead, behind, tape_a, _ = tapes
    d[:, y, np.arange(4)] -= 1
    gx, gu = np.zeros_like(net.x[0]), np.zeros_like(net.u[0])
    into = np.stack([net.out[:, :3].T @ d[t] for t in range(7)])
    lang_gru._back(net.u[0], data, tape_a, into, gx, gu)
    for array, grad, at in ((net.x[0], gx, (1, 98)), (net.x[0], gx, (4, 99)), (net.x[0], gx, (7, 100)), (net.u[0], gu, (0, 1)), (net.u[0], gu, (5, 2)), (net.u[0], gu, (8, 0))):
        old, e = array[at], 1e-2
        array[at] = old + e
        up = loss()
        array[at] = old - e
        down = loss()
        array[at] = old
        assert grad[at] == pytest.approx((up - down) / (2 * e), abs=2e-2)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", held_out("doc_id", 4, 2), "text", "lang")
    net = lang_gru.train(docs.where("not held_out"), docs_per_language=120)
    found = lang_gru.identify(docs, net, ("doc_id", "held_out", "lang")).where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_of_hard_rows(spark, hard, empty):
    docs = spark.createDataFrame([(i, w * 20, lang) for i in range(20) for w, lang in (("der die und ", "de"), ("the of and ", "en"))] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    net = lang_gru.train(docs)
    got = [(r["lang_pred"], r["score"]) for r in lang_gru.identify(hard, net).where("doc_id in (2, 3, 4, 5)").collect()]
    assert got == [("und", 0.0)] * 4
    assert {r["lang_pred"] for r in lang_gru.identify(hard, net).where("doc_id in (1, 6, 7, 8)").collect()} <= {"de", "en"}
    assert lang_gru.train(empty) is None and lang_gru.identify(empty, net).count() == 0
    assert {r["lang_pred"] for r in lang_gru.identify(hard, None).collect()} == {"und"}


def test_probabilities_pool_the_whole_text():
    net = lang_gru.new_net(["a", "b"], 4, np.random.default_rng(1))
    one = b"some words in a row " * 50
    whole = lang_gru.text_probs(net, [one, b"", b"12 34", one + b"zzz" * 300])
    assert whole[1].sum() == whole[2].sum() == 0 and abs(whole[0].sum() - 1) < 1e-5
    assert not np.allclose(whole[0], whole[3])
    assert np.allclose(lang_gru.text_probs(net, [one])[0], lang_gru.text_probs(net, [b"x" * 999, one])[1])


def crc(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


def tokens_of(text):
    return [*(text or "").encode().lower().split(), None]


def test_katz_figures_equal_plain_counts(spark, hard):
    docs = hard.select("doc_id", held_out("doc_id", 10, 0), "text", "score").where("doc_id is not null")
    rows = docs.collect()
    counts = Counter(t for r in rows if not r["held_out"] for t in tokens_of(r["text"]))
    total, distinct = sum(counts.values()), len(counts)
    got = katz.learn_and_score(docs, ~F.col("held_out"))
    assert got.columns == ["doc_id", "held_out", *katz.RESULTS]
    got = got.collect()
    assert len(got) == len(rows)
    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in got:
        t = tokens_of(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[x] > 0 for x in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in t))
        assert r["held_out"] == (crc(r["doc_id"], 10) == 0)


def random_docs(spark, n, seed, size=60, zipf=200):
    rnd = random.Random(seed)
    draw = lambda: f"w{min(int(rnd.paretovariate(0.7)), zipf)}"
    texts = [" ".join(draw() if rnd.random() < 0.8 else "a b c d" for _ in range(rnd.randrange(size))) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_probabilities_add_up_to_one_in_every_context(spark):
    """Of texts that differ in their last word alone, the scores' differences are those of the last word's probability, over all events."""
    train = [(i, r["text"], True) for i, r in enumerate(random_docs(spark, 120, 1, 30, 40).collect())]
    events = sorted({w for _, t, _ in train for w in t.split()} | {"never-seen"})
    contexts = ["", "w1", "a b", "w1 w1", "w2 never-seen", "c d", "d a", "w3 w1"]
    asked = [(1000 + 100 * i + j, f"{c} {w}".strip(), False) for i, c in enumerate(contexts) for j, w in enumerate(events)]
    asked += [(9000 + i, c, False) for i, c in enumerate(contexts)]
    table = spark.createDataFrame(train + asked, "doc_id long, text string, learn boolean")
    prob = plain_katz([t for _, t, _ in train])
    for r in katz.learn_and_score(table, F.col("learn"), block=100, part_bytes=200).collect():
        if r["doc_id"] < 1000:
            continue
        assert r["score"] == pytest.approx(prob(dict((d, t) for d, t, _ in asked)[r["doc_id"]]))
    # The plain model's own sums, with the end and one unknown word as events.
    for c in contexts:
        head = tuple(c.encode().split())[-2:]
        assert sum(prob.of((*head, w)) for w in [*(e.encode() for e in events), None]) == pytest.approx(1.0)


def plain_katz(train, order=3, k=5):
    """log10 P of a text by counts in dictionaries, from the definition."""
    tokens = lambda t: [*t.encode().lower().split(), None]
    counts = [Counter(tuple(w[i : i + n]) for t in train for w in [tokens(t)] for i in range(len(w) - n + 1)) for n in range(1, order + 1)]

    def discounts(c):
        n = Counter(c.values())
        a = (k + 1) * n[k + 1] / n[1] if n[1] else 1
        d = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if a < 1 and n[r] else 0 for r in range(1, k + 1)]
        return d if all(n[r] for r in range(1, k + 2)) and all(0 < x <= 1 for x in d) else None

    ds = [discounts(c) for c in counts]
    total = sum(counts[0].values())

    def share(n, g):
        c = counts[n - 1][g]
        return c * (ds[n - 1][c - 1] if ds[n - 1] and c <= k else 1.0)

    after = {}
    for n in range(2, order + 1):
        for g in counts[n - 1]:
            after.setdefault(g[:-1], []).append(g)

    @lru_cache(None)
    def prob(g):
        n = len(g)
        if n == 1:
            if g not in counts[0]:
                return Counter(counts[0].values())[1] / total if ds[0] else 1 / (total + 1)
            return share(1, g) / (total if ds[0] else total + 1)
        seen = after.get(g[:-1])
        if not seen:
            return prob(g[1:])
        c = counts[n - 2][g[:-1]]
        size = c + 1 if sum(share(n, x) for x in seen) / c > 1 - 1e-9 else c
        if g in counts[n - 1]:
            return share(n, g) / size
        return (1 - sum(share(n, x) for x in seen) / size) / (1 - sum(prob(x[1:]) for x in seen)) * prob(g[1:])

    def score(t):
        return sum(math.log10(prob(tuple(w[max(0, i - order + 1) : i + 1]))) for w in [tokens(t)] for i in range(len(w)))

    score.of, score.discounts = prob, ds
    return score


@pytest.mark.parametrize("of", ["words", "phrases"])
def test_scores_equal_plain_katz(spark, of):
    """Words' and pairs' counts allow discounts in the first corpus, pairs' and triples' in the second."""
    rnd = np.random.default_rng(5)
    phrases = [" ".join(f"w{x}" for x in rnd.integers(0, 60, 4)) for _ in range(2000)] if of == "phrases" else []
    draw = (lambda: " ".join(f"w{min(3000, int(x))}" for x in 20 * rnd.pareto(0.9, rnd.integers(0, 60)))) if of == "words" else (lambda: " ".join(phrases[min(1999, int(x))] for x in 30 * rnd.pareto(0.9, rnd.integers(0, 15))))
    texts = [draw() for _ in range(400)] + ["never w0 w1 seen w0 w0 w0", "", "W0 w1 w2", "w0 w0 w1 w1"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = plain_katz(texts[:300])
    assert [bool(d) for d in score.discounts] == ([True, True, False] if of == "words" else [False, True, True])
    for options in ({}, {"block": 150, "part_bytes": 900}):
        rows = {r["doc_id"]: r for r in katz.learn_and_score(table, F.col("doc_id") < 300, **options).collect()}
        assert set(rows) == set(range(len(texts))) and all(abs(rows[i]["score"] - score(t)) < 1e-6 for i, t in enumerate(texts))


def test_numbers_survive_packing():
    rng = np.random.default_rng(3)
    arrays = [np.zeros(0, np.uint64), np.arange(5), rng.integers(0, 2**63, 1000), np.array([2**64 - 1], np.uint64), np.zeros(7)]
    assert all((a.astype(np.uint64) == b).all() and len(a) == len(b) for a, b in zip(arrays, katz.unpacked(katz.packed(*arrays)), strict=True))


def test_held_out_text_is_better_predicted_than_by_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", held_out("doc_id", 10, 0), "text")
    out = katz.learn_and_score(docs, ~F.col("held_out")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"]


def test_learning_from_nothing(spark, empty, hard):
    got = katz.learn_and_score(hard.select("doc_id", "text"), F.lit(False)).collect()
    assert len(got) == hard.count() and all(r["score"] == 0 and r["base_score"] == pytest.approx(0) and r["n_known"] == 0 for r in got)
    assert katz.learn_and_score(empty.select("doc_id", "text"), F.lit(True)).count() == 0
    assert katz.learn_and_score(hard, F.col("doc_id") < 7).columns == [c for c in hard.columns if c not in ("text", "score")] + list(katz.RESULTS)


def toxic_docs(n, seed):
    """Toxic where an insult meets a group; either alone is harmless."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{rnd.randrange(300)}" for _ in range(30)]
        insult, group = rnd.random() < 0.5, rnd.random() < 0.5
        words += ["insult"] * insult + ["group"] * group
        rnd.shuffle(words)
        out.append((i, " ".join(words), int(insult and group)))
    return out


def test_pairs_are_learnt(spark):
    rows = toxic_docs(1500, 1)
    machine = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, label int"), count=64)
    fresh = toxic_docs(400, 2)
    p = machine.score([t.encode() for _, t, _ in fresh])
    assert np.mean((p >= 0.7) == np.array([y for *_, y in fresh], bool)) >= 0.97


def test_scores_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", held_out("doc_id", 3, 1), "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").selectExpr("doc_id", "toxic as label")
    joined = docs.join(labels, "doc_id")
    machine = toxicity.train(joined.where("not held_out"))
    out = toxicity.score(joined, machine, ("doc_id", "held_out", "label")).where("held_out").collect()
    hits = sum(r["predicted"] for r in out if r["label"] == 1)
    assert hits >= 0.7 * sum(r["label"] for r in out)
    assert sum(r["predicted"] for r in out if r["label"] == 0) <= 0.01 * len(out)


def test_toxicity_of_hard_rows(spark, hard, empty):
    rows = [(i, "you idiot" if i % 2 else "kind words", i % 2) for i in range(40)] + [(90, None, 1), (91, "", 0), (92, "x", None)]
    machine = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    got = toxicity.score(hard, machine).collect()
    assert len(got) == hard.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 4)}) == 1
    assert toxicity.score(empty, machine).count() == 0
    assert toxicity.train(spark.createDataFrame(rows[:1], "doc_id long, text string, label int")) is None
    assert {r["score"] for r in toxicity.score(hard, None).collect()} == {0.0}


def test_discounts_hold_in_a_corpus_of_millions_of_tokens(spark):
    """Above five million tokens n-grams seen once are still counted, discounted and used."""
    rnd = np.random.default_rng(7)
    texts = [" ".join(f"w{min(int(x), 400_000)}" for x in 30 * rnd.pareto(0.8, 1000)) for _ in range(5200)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in katz.learn_and_score(table, F.col("doc_id") < 9000).collect()}
    assert got[0]["train_tokens"] == 5200 * 1001
    w = [*texts[5].split(), None]
    asked = {n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for n in (1, 2, 3)}
    counts = Counter(g for t in texts for v in [[*t.split(), None]] for n in (1, 2, 3) for i in range(len(v) - n + 1) if (g := tuple(v[i : i + n])) in asked[n])
    shares = [counts[tuple(w[max(0, i - 2) : i + 1])] / (counts[tuple(w[max(0, i - 2) : i])] if i else 5200 * 1001) for i in range(len(w))]
    plain = sum(map(math.log10, shares))
    once = sum(counts[tuple(w[i - 2 : i + 1])] == 1 for i in range(2, len(w)))
    assert once > 500 and plain - 1.5 * once < got[5]["score"] < plain - 0.02 * once
    assert got[5]["score"] > 0.9 * got[5]["base_score"]
