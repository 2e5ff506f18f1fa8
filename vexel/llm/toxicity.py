"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words (runs of letters and digits, A-Z lower-cased) and the first 4 and 5 bytes of its
words, all as 64-bit hashes. The machine sums a weight for each term and, for each pair of terms, the inner product of
their factors, so it learns pairs (an insult with the mention of a group) that a sum of weights misses.

Learning: every labelled row counts towards the terms' document frequencies by label; the `terms` most telling ones (by
the G statistic, in at least `least` rows) are the machine's. It is fitted in numpy on a bounded sample: the
`sample_rows` labelled rows whose ids hash lowest, of which only these terms reach the driver.

Null and empty texts have no terms and get the bias alone. Without labels of both kinds every score is 0. Texts of any length
are read whole; of terms equally telling those with the smaller hash are taken. Rows labelled twice count twice, repeated rows are
scored each, the empty table gives the empty table. Extra columns are not returned, nor read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.words import ALNUM, U64, Index, counted, mix, run_hashes, segments, text_chunks

TERMS, LEAST, SAMPLE_ROWS, FACTORS = 1024, 5, 20_000, 8
PREFIXES = (None, 4, 5)


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' terms, distinct in each text, and the text of each."""
    kinds, offsets = run_hashes(texts, ALNUM, PREFIXES)
    doc = segments(offsets)
    salted = np.concatenate([mix(k + U64(977 * i)) for i, k in enumerate(kinds)])
    docs = np.tile(doc, len(kinds))
    order = np.lexsort((salted, docs))
    salted, docs = salted[order], docs[order]
    new = np.ones(len(docs), bool)
    new[1:] = (np.diff(docs) != 0) | (salted[1:] != salted[:-1])
    return salted[new], docs[new]


@dataclass
class Machine:
    keys: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        values, docs = terms(texts)
        hit = Index(self.keys).find(values)
        at = hit >= 0
        return self.of_terms(hit[at], docs[at], len(texts))

    def of_terms(self, ids: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        raw = self.bias + np.bincount(docs, weights=self.weights[ids], minlength=n)
        for f in self.factors.T:
            v = f[ids]
            raw += 0.5 * (np.bincount(docs, weights=v, minlength=n) ** 2 - np.bincount(docs, weights=v * v, minlength=n))
        return 1 / (1 + np.exp(-np.clip(raw, -60, 60)))


def telling_terms(labelled: DataFrame, count: int, least: int) -> tuple[np.ndarray, int, int]:
    """The most telling terms, sorted, and how many rows have label 0 and 1; from columns text, label (0 or 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["term", "bad", "good"]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            value, label = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys, n = counted(value)
            bad = np.zeros(len(keys), np.int64)
            hit, m = counted(value[label == 1])
            bad[np.searchsorted(keys, hit)] = m
            for i in range(0, len(keys), 200_000):
                s = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[s].view(np.int64)), pa.array(bad[s]), pa.array(n[s] - bad[s])], names=names)

        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end, texts in text_chunks(batch, 0):
                values, docs = terms(texts)
                parts.append((values, label[first:end][docs]))
                size += len(values)
                if size > 4_000_000:
                    yield from flush()
                    parts, size = [], 0
        if size:
            yield from flush()

    rows = labelled.agg(F.count_if(F.col("label") == 0).alias("good"), F.count_if(F.col("label") == 1).alias("bad")).first()
    good, bad = rows["good"], rows["bad"]
    if not good or not bad:
        return np.zeros(0, U64), good, bad
    found = labelled.select("text", "label").mapInArrow(run, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    seen = F.col("bad") + F.col("good")
    g = sum((share(o, seen * (n / (good + bad))) + share(n - o, (good + bad - seen) * (n / (good + bad))) for o, n in ((F.col("bad"), bad), (F.col("good"), good))), F.lit(0.0))
    best = found.where(seen >= least).select("term", g.alias("g")).orderBy(F.desc("g"), "term").limit(count)
    return np.sort(np.array([r["term"] for r in best.collect()], dtype=np.int64).view(U64)), good, bad


def fit(rows: list[np.ndarray], labels: np.ndarray, keys: np.ndarray, factors: int = FACTORS, steps: int = 800, batch: int = 512, rate: float = 0.02, decay: float = 2e-4, seed: int = 1) -> Machine:
    """Adam on the logistic loss; rows are the numbers of each sample row's terms."""
    rng = np.random.default_rng(seed)
    x = np.zeros((len(rows), len(keys)), np.uint8)
    for i, r in enumerate(rows):
        x[i, r] = 1
    w, v, bias = np.zeros(len(keys)), rng.standard_normal((len(keys), factors)) * 0.02, np.zeros(1)
    bias[0] = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, v, bias)]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(rows), min(batch, 4 * len(rows)))
        xs, y = x[pick].astype(float), labels[pick]
        xv = xs @ v
        raw = bias[0] + xs @ w + 0.5 * ((xv**2).sum(axis=1) - xs @ (v**2).sum(axis=1))
        d = (1 / (1 + np.exp(-np.clip(raw, -60, 60))) - y) / len(pick)
        gw = xs.T @ d + decay * w
        gv = xs.T @ (d[:, None] * xv) - v * (xs.T @ d)[:, None] + decay * v
        for p, g, (a, b) in zip((w, v, bias), (gw, gv, np.array([d.sum()])), state, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (1 - step / (steps + 1)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Machine(keys, w, v, float(bias[0]))


def train(labelled: DataFrame, count: int = TERMS, least: int = LEAST, sample_rows: int = SAMPLE_ROWS) -> Machine | None:
    """A machine from columns doc_id, text, label (0, 1 or null: unlabelled)."""
    labelled = labelled.where("label in (0, 1)").select("doc_id", "text", "label")
    keys, good, bad = telling_terms(labelled, count, least)
    if not good or not bad:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(keys)
        for batch in batches:
            for first, end, texts in text_chunks(batch, 0):
                values, docs = terms(texts)
                hit = index.find(values)
                docs, hit = docs[hit >= 0], hit[hit >= 0]
                lists = pa.ListArray.from_arrays(np.searchsorted(docs, np.arange(end - first + 1)).astype(np.int32), pa.array(hit.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, *(batch.column(i).slice(first, end - first) for i in (1, 2))], names=["ids", "label", "rank"])

    rank = F.xxhash64("doc_id").alias("rank")
    sample = labelled.select("text", F.col("label").cast("int").alias("label"), rank).mapInArrow(run, "ids array<int>, label int, rank long").orderBy("rank", "label", "ids").limit(sample_rows).toArrow()
    ids = [np.array(r, np.int64) for r in sample["ids"].to_pylist()]
    return fit(ids, sample["label"].to_numpy().astype(float), keys)


def score(docs: DataFrame, machine: Machine | None, keys: tuple[str, ...] = ("doc_id",), threshold: float = 0.7) -> DataFrame:
    """The key columns with score and predicted, from column text."""
    kept = docs.select(*keys).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, texts in text_chunks(batch, 0):
                found = machine.score(texts) if machine else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, end - first) for i in range(1, batch.num_columns)), pa.array(found)], names=[*keys, "score"])

    return docs.select("text", *keys).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
