"""op4 and op8 against brute force, and their edge cases."""

import random
import re

import numpy as np

from tests.llm.conftest import ENGLISH, LONG
from vexel.llm import jaccard_join, substring_dedup
from vexel.llm.components import components
from vexel.llm.words import shingles, word_hashes


def words_of(text):
    return (text or "").encode().lower().split()


def set_of(text, n=5):
    w = words_of(text)
    if len(w) >= n:
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def brute_components(docs):
    sets, group = {d: set_of(t) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(3)) for _ in range(300)]
    common = [rnd.choice(vocabulary) for _ in range(40)]
    seeds = [[rnd.choice(vocabulary) for _ in range(rnd.choice((3, 6, 8, 10, 14, 40, 90, 200)))] for _ in range(12)]
    docs = []
    for i in range(n):
        w = list(rnd.choice(seeds))
        for _ in range(rnd.randrange(0, 1 + len(w) // 20 + 1)):
            k = rnd.randrange(len(w))
            rnd.choice((lambda: w.__setitem__(k, "new"), lambda: w.insert(k, "more"), lambda: w.pop(k) if len(w) > 2 else None))()
        if i % 7 == 0:
            w += common
        docs.append((i * 3 + 1, " ".join(w)))
    return docs


def test_components_equal_brute_force(spark):
    for seed in (1, 2, 3):
        docs = near_copies(seed)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got == brute_components(docs)


def test_every_boundary_gives_keys_to_linked_sets():
    rnd = np.random.default_rng(1)
    for n in range(3, 60):
        base = np.unique(rnd.integers(0, 2**62, n + 5).astype(np.uint64))[:n]
        for cut in range(0, n // 4 + 1):
            other = np.unique(np.concatenate([base[cut:], rnd.integers(0, 2**62, rnd.integers(0, 3)).astype(np.uint64)]))
            both = jaccard_join.common(base, other)
            if len(other) < 3 or 7 * both < 3 * (len(base) + len(other)):
                continue
            for light in (2, 5, 10, n, 64):
                (a, pa), (b, pb) = (jaccard_join.keyed(0, np.sort(s), light) for s in (base, other))
                shared = [(i, j) for i, k in enumerate(a.tolist()) for j in np.flatnonzero(b == k).tolist()]
                assert any(7 * min(len(base) - pa[i], len(other) - pb[j]) >= 3 * (len(base) + len(other)) for i, j in shared)


def test_hard_rows(spark, hard, empty):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_join.join(hard).collect())
    n, long = len(set_of(ENGLISH)), len(set_of(LONG))
    assert got == [(False, 1, n, 1), (False, 2, 0, 2), (False, 3, 0, 3), (False, 4, 0, 4), (False, 5, 1, 5), (False, 6, long, 6), (False, 7, n, 1), (False, 7, n, 1), (False, 8, 3, 8), (True, 0, 7, None)]
    assert jaccard_join.join(empty).count() == 0


def test_a_large_group_of_copies_is_one_component(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", f"concat('{ENGLISH.replace(chr(39), '')}', if(id % 2 = 0, '', concat('tail', cast(id % 50 as string)))) as text")
    assert jaccard_join.join(docs).select("component_id").distinct().count() == 1


def test_shingle_hashes_are_one_to_one_with_shingles():
    texts = ["a b c d e f", "A B C D E F", "a b c", "", "x", "a\tb\x0bc\x0cd\re\nf", "a b"]
    values, offsets = shingles(*word_hashes([t.encode() for t in texts]), 5)
    sets = [frozenset(values[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)]
    plain = [set_of(t) for t in texts]
    assert [[a == b for b in sets] for a in sets] == [[a == b for b in plain] for a in plain]
    assert list(map(len, sets)) == list(map(len, plain))


def test_connected_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(80)] + [(-5, -9), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


WORD = re.compile(r"[^\W_]+")


def held_words(texts, k):
    """Every run of k words that a smaller doc_id has: run -> smallest doc_id."""
    first = {}
    for d, t in sorted(texts.items()):
        w = WORD.findall(t.lower())
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d)
    return first


def check_dedup(docs, got):
    """docs, got: doc_id -> text. Long repeats are gone, nothing else is: by plain runs of words, without sentences or hashes."""
    long, short = substring_dedup.LEAST_WORDS + 2 * substring_dedup.WINDOW, substring_dedup.LEAST_WORDS
    longest, least = held_words(docs, long), held_words(docs, short)
    triples = held_words(docs, 3)
    for d, text in docs.items():
        w, left = WORD.findall(text.lower()), WORD.findall(got[d].lower())
        for i in range(len(left) - long + 1):
            assert longest.get(tuple(left[i : i + long]), d) == d, (d, left[i : i + long])
        if all(least[tuple(w[i : i + short])] == d for i in range(len(w) - short + 1)) and len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) == len(w) - 2:
            assert got[d] == text
        seen, repeats = set(), set()
        for i in range(len(w) - 2):
            run = tuple(w[i : i + 3])
            if triples[run] < d or run in seen:
                repeats |= {i, i + 1, i + 2}
            seen.add(run)
        assert len(w) - len(left) <= len(repeats)


def run_dedup(spark, docs):
    return {r["doc_id"]: (r["text"], r["n_removed"]) for r in substring_dedup.dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}


def test_planted_passages_go_but_for_the_first(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    sentence = lambda n: " ".join(word() for _ in range(rnd.randrange(1, n))).capitalize() + rnd.choice((". ", "! ", ".\n", "? "))
    prose = lambda words, n: (lambda w: " ".join(w[:words]))("".join(sentence(n) for _ in range(words)).split())
    docs, planted = {}, {}
    for kind, n in enumerate((2, 7, 12, 30, 90)):
        passages = [prose(size, n) for size in (51, 54, 60, 75, 120, 300)]
        formula = prose(25, n)
        for i in range(60):
            own = [prose(rnd.randrange(10, 90), n) for _ in range(3)]
            d = 100 * kind + i
            if i % 3 == 0:
                docs[d] = f"{own[0]} {formula} {own[1]}"
            else:
                docs[d] = f"{own[0]} {passages[i % 6]} {own[1]} {own[2]}"
                planted[d] = passages[i % 6], i >= 6
    got = run_dedup(spark, docs)
    check_dedup(docs, {d: t for d, (t, _) in got.items()})
    caught = [got[d][1] > 0 and p not in got[d][0] for d, (p, later) in planted.items() if later]
    assert sum(caught) >= 0.98 * len(caught)
    covered = [sum(w in got[d][0].split() for w in p.split()) / len(p.split()) for d, (p, later) in planted.items() if later]
    assert sum(c <= 0.3 for c in covered) >= 0.9 * len(covered)
    assert all(got[d] == (docs[d], 0) for d in docs if d not in planted or not planted[d][1])


def test_real_texts(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect()}
    check_dedup(docs, {d: t for d, (t, _) in run_dedup(spark, docs).items()})


def cut(text):
    s = substring_dedup.Sentences([text])
    at = [0, *s.starts[s.cuts[1:]].tolist(), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


def test_sentences_give_the_text_again():
    for t in (ENGLISH * 3, "a.b c! d?\n\n e", "no end", "word " * 500, "x\n\n\ny", "é. ñ! 漢字? z", "\U0001f600 a \ud800 b"):
        assert "".join(cut(t)) == t
    assert max(len(s.split()) for s in cut(numbered(0, 500))) <= 2 * substring_dedup.WINDOW
    assert sum(s.endswith((". ", "night. ")) for s in cut(ENGLISH * 3)) >= 6


def test_sentences_are_the_same_in_any_batch():
    rnd = random.Random(7)
    texts = [numbered(rnd.randrange(50), rnd.randrange(0, 90)) + rnd.choice(("", ".", "\n", " -")) for _ in range(60)]
    together = substring_dedup.Sentences(texts)
    text, at, h, again = together.spans()
    alone = [(i, *x) for i, t in enumerate(texts) for x in zip(*(v.tolist() for v in substring_dedup.Sentences([t]).spans()[1:]), strict=True)]
    assert sorted(zip(text.tolist(), at.tolist(), h.tolist(), again.tolist(), strict=True)) == sorted(alone)


def test_dedup_of_hard_rows(spark, hard, empty):
    out = substring_dedup.dedup(hard)
    assert set(out.columns) == set(hard.columns) | {"n_removed"} and out.count() == hard.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] != 7}
    assert texts[1] == ENGLISH and texts[2] is None and texts[3] == "" and "fox" not in texts[6] and len(texts[6]) > 200_000
    assert substring_dedup.dedup(empty).count() == 0


def test_rows_of_one_document(spark):
    """Equal rows stay alike; different texts of one doc_id don't repeat each other, and lose each what is its own repeat."""
    a, b = numbered(0, 80), numbered(500, 90)
    rows = [(1, a), (2, a), (2, a), (2, b + " " + a), (2, b), (None, a), (3, None)]
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert (1, a, 0) in got and (None, a, 0) in got and (3, None, 0) in got and (2, b, 0) in got
    equal = [x for x in got if x[0] == 2 and "v500" not in x[1]]
    assert len(equal) == 2 and equal[0] == equal[1] and len(equal[0][1].split()) < 20
    (mixed,) = [x for x in got if x[0] == 2 and "v500" in x[1] and x[2] > 0]
    assert mixed[1].startswith(b.rsplit(" ", 8)[0]) and len(mixed[1].split()) < 110


def numbered(first, n):
    return " ".join(f"v{i}" for i in range(first, first + n))


def test_passages_without_sentence_ends_are_found_at_any_offset(spark):
    passage = numbered(0, 60)
    docs = {1: f"{numbered(1000, 11)} {passage} {numbered(2000, 30)}", 2: f"{numbered(3000, 28)} {passage} {numbered(4000, 17)}"}
    got = run_dedup(spark, docs)
    assert got[1][0] == docs[1]
    left = got[2][0].split()
    assert sum(w in passage.split() for w in left) <= 18 and {*numbered(3000, 28).split(), *numbered(4000, 17).split()} <= set(left)


def test_sentences_of_other_scripts():
    one, two = "漢字仮名" * 2 + "。", "東京都" * 2 + "！"
    assert cut(one + two) == [one, two]
    assert cut("यह एक वाक्य है। यह दूसरा है।")[0].endswith(("। ", "यह ", "एक ", "वाक्य "))
    assert len(cut("漢字仮名" * 60)) >= 6 and "".join(cut("漢字仮名" * 60)) == "漢字仮名" * 60


def test_passages_are_sought_in_small_chunks():
    texts = ["x" * 100_000] * 30 + [None]
    chunks = list(substring_dedup._chunks(texts))
    assert sum(len(c) for _, c in chunks) == 31 and max(sum(map(len, c)) for _, c in chunks) < 400_000
