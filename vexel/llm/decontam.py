"""Benchmark decontamination by CGK embedding, bit sampling and exact edit verification.

Texts and items are sequences of words (letters, digits and non-ASCII; A-Z lower-cased). An item leaks into a document
if some run of the document's words is within `max_edits` of the item's length of it by edit distance over words.

* Items are put into classes of similar length. At every word starts one window for each class; only those that hold
  enough words of the class's items to be within the distance at all go on (nothing is lost by that).
* The CGK random walk writes the word under a pointer at each step, and moves the pointer on by a random bit of the word
  and the step. It turns few edits into few differing places. A sample of `symbols` places is one hash key; windows that
  share a key with an item are candidates. The number of repetitions is set so that, with the share of equal places
  measured on edited items, a leak at the very limit is found with probability `recall`; unedited ones always are.
* Candidates are verified by exact edit distance of the item to the best run around the window.

Items are broadcast in blocks of at most `block` items. Items without words take no part; null and empty texts match
nothing. Repeated rows of either table give repeated results. Extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vexel.llm.session import small_batches, written
from vexel.llm.words import ALNUM, U64, Index, mix, run_hashes, segments, text_chunks

MAX_EDITS, RECALL, SYMBOLS, WALKS = 0.2, 0.95, 3, 4
#: Repetitions at most, far above what any length has been seen to need; windows keyed at a time.
MOST, WINDOWS = 4096, 8192
PAD = U64(0x6A09E667F3BCC909)
_STEP = U64(0x9FB21C651E98DF25)


def walk(words: np.ndarray, at: np.ndarray, end: np.ndarray, steps: int, salt: int, wanted: np.ndarray, coins: dict) -> np.ndarray:
    """(len(wanted), len(at)): what the walks from `at`, in texts that end at `end`, write at the wanted steps.

    coins keeps the random bits of these words for further walks.
    """
    out = np.empty((len(wanted), len(at)), U64)
    slot = {int(s): i for i, s in enumerate(wanted)}
    padded = np.append(words, PAD)
    pos = at.copy()
    bits = np.zeros(0, U64)
    for j in range(steps):
        if j % 64 == 0:
            number = salt * 1000 + j // 64 + 1
            if number not in coins:
                coins[number] = mix(padded + np.full(1, number, U64) * _STEP)
            bits = coins[number]
        now = np.minimum(pos, len(words))
        now[pos >= end] = len(words)
        if j in slot:
            out[slot[j]] = padded[now]
        pos += ((bits[now] >> U64(j % 64)) & U64(1)).astype(np.int64)
    return out


def edit_distance(item: np.ndarray, text: np.ndarray) -> int:
    """The least edit distance of the item to any run of the text."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, w in enumerate(item.tolist()):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


@dataclass
class Class:
    """Items of similar length: sampled steps by repetition, and the keys' items."""

    shortest: int
    longest: int
    member: np.ndarray  # for each word of the plan's vocabulary, and last for all others, whether it is in an item
    steps: np.ndarray  # (repetitions, symbols)
    keys: Index
    first: np.ndarray  # for each key, where its items begin in `items`
    items: np.ndarray


@dataclass
class Plan:
    ids: list
    words: list[np.ndarray]
    max_edits: float
    vocabulary: Index
    classes: list[Class] = field(default_factory=list)


def _keys(words: np.ndarray, at: np.ndarray, end: np.ndarray, steps: np.ndarray, coins: dict | None = None) -> np.ndarray:
    """(repetitions, windows): hash keys; repetition r uses walk r % WALKS."""
    out = np.empty((len(steps), len(at)), U64)
    coins = {} if coins is None else coins
    for w in range(min(WALKS, len(steps))):
        mine = steps[w::WALKS]
        wanted = np.unique(mine)
        seen = walk(words, at, end, int(wanted[-1]) + 1, w, wanted, coins)
        for k, places in enumerate(np.searchsorted(wanted, mine)):
            h = np.full(len(at), w + WALKS * k + 1, U64) * _STEP
            for p in places:
                h = mix(h ^ seen[p])
            out[w + WALKS * k] = h
    return out


def plan(items: list[tuple[object, bytes]], max_edits: float = MAX_EDITS, recall: float = RECALL, symbols: int = SYMBOLS, seed: int = 1) -> Plan:
    (hashes,), offsets = run_hashes([t for _, t in items], ALNUM, (None,))
    words = [hashes[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
    made = Plan([i for i, _ in items], words, max_edits, Index(np.unique(hashes)))
    rng = np.random.default_rng(seed)
    by_class: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w):
            by_class.setdefault(int(np.log(len(w)) / np.log(1.12)), []).append(i)
    for members in by_class.values():
        sizes = [len(words[i]) for i in members]
        span = max(symbols, int(1.6 * min(sizes)))
        trial = rng.integers(0, span, (MOST, symbols))
        same = _equal_keys([words[members[k]] for k in rng.integers(0, len(members), 60)], trial[:48], max_edits, rng)
        repetitions = int(np.clip(np.ceil(np.log(1 - recall) / np.log(1 - min(same, 1 - 1e-9))), WALKS, len(trial)))
        steps = trial[:repetitions]
        joined = np.concatenate([words[i] for i in members])
        at = np.cumsum([0, *sizes[:-1]])
        keys = _keys(joined, at, at + np.array(sizes), steps).ravel()
        order = np.argsort(keys, kind="stable")
        distinct, first = np.unique(keys[order], return_index=True)
        owner = np.tile(np.array(members), repetitions)[order]
        member = np.zeros(len(made.vocabulary.keys) + 1, bool)
        member[made.vocabulary.find(joined)] = True
        made.classes.append(Class(min(sizes), max(sizes), member, steps, Index(distinct), np.append(first, len(owner)), owner))
    return made


def _equal_keys(items: list[np.ndarray], steps: np.ndarray, max_edits: float, rng: np.random.Generator) -> float:
    """How often a key of an item equals that of the item with as many random edits as are allowed."""
    hits = total = 0
    for item in items:
        edited = list(item)
        for _ in range(int(max_edits * len(item))):
            k, kind = int(rng.integers(0, max(1, len(edited)))), int(rng.integers(0, 3))
            new = U64(rng.integers(1, 2**63))
            if kind == 0 and edited:
                edited[k] = new
            elif kind == 1:
                edited.insert(k, new)
            elif len(edited) > 1:
                del edited[k]
        other = np.array(edited, U64)
        both = np.concatenate([item, other])
        keys = _keys(both, np.array([0, len(item)]), np.array([len(item), len(both)]), steps)
        hits += int((keys[:, 0] == keys[:, 1]).sum())
        total += len(steps)
    return max(hits / max(1, total), 1e-3)


def leaks(made: Plan, words: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, item, edits) for texts whose words and beginnings are given."""
    doc = segments(offsets)
    ends = offsets[1:][doc]
    best: dict[tuple[int, int], int] = {}
    known = made.vocabulary.find(words)
    coins: dict = {}
    for c in made.classes:
        inside = np.concatenate([[0], np.cumsum(c.member[known])])
        # A run within d edits of an item of n words has at least n - d of them, on at most n + d places.
        reach = int(c.longest * (1 + made.max_edits))
        need = c.shortest - int(made.max_edits * c.shortest)
        start = np.arange(len(words))
        at = np.flatnonzero(inside[np.minimum(start + reach, ends)] - inside[:-1] >= need)
        if not len(at):
            continue
        met = [np.zeros(0, np.int64)]
        for a in range(0, len(at), WINDOWS):
            part = at[a : a + WINDOWS]
            hit = c.keys.find(_keys(words, part, ends[part], c.steps, coins).ravel())
            found = np.flatnonzero(hit >= 0)
            counts = c.first[hit[found] + 1] - c.first[hit[found]]
            item = c.items[np.repeat(c.first[hit[found]], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
            met.append(np.unique(item.astype(np.int64) << 40 | np.repeat(part[found % len(part)], counts)))
        pairs = np.concatenate(met)
        for i, p in zip((pairs >> 40).tolist(), (pairs & ((1 << 40) - 1)).tolist(), strict=True):
            key = (int(doc[p]), i)
            if best.get(key) == 0:
                continue
            w = made.words[i]
            limit = int(made.max_edits * len(w))
            text = words[max(offsets[key[0]], p - limit) : min(offsets[key[0] + 1], p + len(w) + limit)]
            if len(set(w.tolist()) & set(text.tolist())) < len(set(w.tolist())) - limit:
                continue
            d = edit_distance(w, text)
            if d <= limit and d < best.get(key, limit + 1):
                best[key] = d
    return [(t, i, d) for (t, i), d in best.items()]


def matches(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS, block: int = 20_000, **options) -> DataFrame:
    """doc_id, item_id, edits: each leak, from docs (doc_id, text) and items (item_id, text)."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    blocks = max(1, -(-items.count() // block))
    parts = []
    for b in range(blocks):
        mine = items.where(F.coalesce(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)), F.lit(0)) == b).select("item_id", "text")
        rows = sorted(((r["item_id"], (r["text"] or "").encode()) for r in mine.collect()), key=lambda r: (str(r[0]), r[1]))
        now = spark.sparkContext.broadcast(plan(rows, max_edits, **options))
        parts.append(small_batches(docs.select("text", "doc_id")).mapInArrow(_finder(now, to_arrow_type(items.schema["item_id"].dataType)), f"doc_id {kind}, item_id {item_kind}, edits int"))
    return reduce(DataFrame.unionByName, parts)


def _finder(now, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, texts in text_chunks(batch, 0):
                (words,), offsets = run_hashes(texts, ALNUM, (None,))
                found = leaks(now.value, words, offsets)
                rows = pa.array([first + t for t, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(1).take(rows), pa.array([now.value.ids[i] for _, i, _ in found], kind), pa.array([d for _, _, d in found], pa.int32())], names=["doc_id", "item_id", "edits"])

    return run


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents into which no item leaks, with all their columns."""
    bad = written(matches(docs, items, **options).select("doc_id").distinct(), "leaks")
    return docs.join(bad, "doc_id", "left_anti")
