"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

Training is numpy backpropagation through time on a bounded sample: `docs_per_language` documents of each label value
(those whose ids hash lowest), `windows` windows of each. Prediction reads every byte of every text, in windows of
`WINDOW` bytes side by side: every position gets probabilities of the languages, and a text's are the mean of those of
its positions (padding and ASCII other than letters aside).

Null texts and texts without a letter get `und` and score 0; so does everything where there is nothing to learn from.
Ties go to the language first in order. Extra columns are not returned. Repeated rows are predicted each; the empty table gives
the empty table. Rows without doc_id are ranked by their text where the sample is drawn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.llm.session import small_batches
from vexel.llm.words import text_chunks

WINDOW, HIDDEN = 128, 8
_COUNTS = np.zeros(256, np.float32)
_COUNTS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


@dataclass
class Net:
    """x: (2, 3h, 256) what each byte adds to the gates; u: (2, 3h, h); out: (languages, 2h); bias: (languages, 1). Gates: keep, reset, new."""

    languages: list[str]
    x: np.ndarray
    u: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.u, self.out, self.bias]


def new_net(languages: list[str], hidden: int, rng: np.random.Generator) -> Net:
    f = np.float32
    draw = lambda s, *shape: (rng.standard_normal(shape) * s).astype(f)
    return Net(languages, draw(0.3, 2, 3 * hidden, 256), draw(0.4 / hidden**0.5, 2, 3 * hidden, hidden), draw(0.3, len(languages), 2 * hidden), np.zeros((len(languages), 1), f))


def _states(x: np.ndarray, u: np.ndarray, data: np.ndarray, keep: bool):
    """States after each position of data (time, batch), and with keep=True what going back needs."""
    h3, h = u.shape
    state = np.zeros((h, data.shape[1]), np.float32)
    states, tape = [], []
    for codes in data:
        gates = np.take(x, codes, axis=1)
        inner = u @ state
        zr = gates[: 2 * h]
        zr += inner[: 2 * h]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        n = zr[h:] * inner[2 * h :]
        n += gates[2 * h :]
        np.tanh(n, out=n)
        before = state
        state = state - n
        state *= zr[:h]
        state += n
        states.append(state)
        if keep:
            tape.append((before, zr, inner[2 * h :], n))
    return states, tape


def _back(u: np.ndarray, data: np.ndarray, tape: list, into: np.ndarray, dx: np.ndarray, du: np.ndarray) -> None:
    """Adds to dx and du what the loss's gradients by the states (time, h, batch) make of them."""
    h = u.shape[1]
    steps, batch = data.shape
    adds = np.empty((3 * h, steps, batch), np.float32)
    later = np.zeros((h, batch), np.float32)
    for t in range(steps - 1, -1, -1):
        before, zr, inner, n = tape[t]
        z, r = zr[:h], zr[h:]
        g = into[t] + later
        dn = g * (1 - z) * (1 - n * n)
        by_u = np.empty((3 * h, batch), np.float32)
        by_u[:h] = g * (before - n) * 2 * z * (1 - z)
        by_u[h : 2 * h] = dn * inner * 2 * r * (1 - r)
        by_u[2 * h :] = dn * r
        adds[: 2 * h, t] = by_u[: 2 * h]
        adds[2 * h :, t] = dn
        du += by_u @ before.T
        later = g * z + u.T @ by_u
    codes = data.ravel()
    for k in range(3 * h):
        dx[k] += np.bincount(codes, weights=adds[k].ravel(), minlength=256)


def position_probs(net: Net, data: np.ndarray, tapes: list | None = None) -> np.ndarray:
    """(time, languages, batch): each position's probabilities."""
    h = net.u.shape[2]
    ahead, tape_a = _states(net.x[0], net.u[0], data, tapes is not None)
    behind, tape_b = _states(net.x[1], net.u[1], data[::-1], tapes is not None)
    logits = np.empty((len(data), len(net.languages), data.shape[1]), np.float32)
    for t in range(len(data)):
        np.matmul(net.out[:, :h], ahead[t], out=logits[t])
        logits[t] += net.out[:, h:] @ behind[-1 - t]
    logits += net.bias
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    if tapes is not None:
        tapes += [ahead, behind, tape_a, tape_b]
    return logits


def fit(windows: list[bytes], labels: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = 240, batch: int = 128, rate: float = 0.02, seed: int = 1) -> Net:
    """Adam on the cross-entropy of every position."""
    rng = np.random.default_rng(seed)
    net = new_net(languages, hidden, rng)
    data = np.zeros((len(windows), WINDOW), np.int64)
    mask = np.zeros((len(windows), WINDOW), np.float32)
    for i, w in enumerate(windows):
        codes = np.frombuffer(w[:WINDOW], np.uint8)
        data[i, : len(codes)] = codes
        mask[i, : len(codes)] = _COUNTS[codes]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    by_label = [np.flatnonzero(labels == k) for k in range(len(languages))]
    h = hidden
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(b, max(1, batch // len(languages))) for b in by_label if len(b)])
        x, m, y = np.ascontiguousarray(data[rows].T), mask[rows].T, labels[rows]
        tapes: list = []
        p = position_probs(net, x, tapes)
        ahead, behind, tape_a, tape_b = tapes
        p[:, y, np.arange(len(rows))] -= 1
        d = p * (m / max(1.0, m.sum()))[:, None, :]
        grads = [np.zeros_like(q) for q in net.parameters()]
        into = [np.empty((len(x), h, len(rows)), np.float32) for _ in range(2)]
        for t in range(len(x)):
            grads[2][:, :h] += d[t] @ ahead[t].T
            grads[2][:, h:] += d[t] @ behind[-1 - t].T
            into[0][t] = net.out[:, :h].T @ d[t]
            into[1][-1 - t] = net.out[:, h:].T @ d[t]
        grads[3][:, 0] = d.sum(axis=(0, 2))
        _back(net.u[0], x, tape_a, into[0], grads[0][0], grads[1][0])
        _back(net.u[1], x[::-1], tape_b, into[1], grads[0][1], grads[1][1])
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for q, g, (a, b) in zip(net.parameters(), grads, moments, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def train(docs: DataFrame, docs_per_language: int = 300, windows: int = 6) -> Net | None:
    """A net from columns doc_id, text, lang; None if no row has both a text with a letter and a language."""
    usable = docs.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("lang", "text", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")).alias("rank"))
    # Of a language with many documents only the lowest hashes, a few times as many as are wanted, are ranked at all.
    share = {r["lang"]: min(1.0, 4 * docs_per_language / r["count"]) for r in usable.groupBy("lang").count().collect()}
    if not share:
        return None
    below = F.create_map(*(F.lit(x) for lang, part in share.items() for x in (lang, part)))
    drawn = usable.where((F.col("rank") / 2.0**64 + 0.5) <= F.element_at(below, F.col("lang")))
    numbers = F.sequence(F.lit(1), F.lit(windows))
    cuts = F.transform(numbers, lambda i: F.substring("text", (F.pmod(F.xxhash64("rank", i), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)))
    order = Window.partitionBy("lang").orderBy("rank", "cuts")
    sample = drawn.select("lang", "rank", cuts.alias("cuts")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_per_language)
    cut = sample.select("lang", F.explode("cuts").alias("text"))
    rows = sorted(map(tuple, cut.collect()))  # languages * docs_per_language * windows short texts at most
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    return fit([r[1].encode() for r in rows], np.array([languages.index(r[0]) for r in rows]), languages)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def text_probs(net: Net, texts: list[bytes], batch: int = 2048) -> np.ndarray:
    """(texts, languages): the mean of the positions' probabilities; zeros for texts without a position that counts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    buf = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    each = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(texts)), each)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    start = (np.cumsum(lengths) - lengths)[owner] + k * WINDOW
    size = np.minimum(lengths[owner] - k * WINDOW, WINDOW)
    total = np.zeros((len(texts), len(net.languages)))
    seen = np.zeros(len(texts))
    steps = np.arange(WINDOW)
    for a in range(0, len(owner), batch):
        b = min(len(owner), a + batch)
        data = buf[start[a:b] + steps[:, None]].astype(np.intp)
        weight = _COUNTS[data] * (steps[:, None] < size[a:b])
        data *= steps[:, None] < size[a:b]
        p = position_probs(net, data)
        pooled = np.einsum("tlb,tb->bl", p, weight)
        np.add.at(total, owner[a:b], pooled)
        np.add.at(seen, owner[a:b], weight.sum(axis=0))
    return total / np.maximum(seen, 1)[:, None]


def identify(docs: DataFrame, net: Net | None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns with lang_pred and score, from column text."""
    kept = docs.select(*keys).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, texts in text_chunks(batch, 0):
                p = text_probs(net, texts) if net else np.zeros((len(texts), 1))
                best, top = p.argmax(axis=1), p.max(axis=1)
                names = [net.languages[k] if net and s > 0 else "und" for k, s in zip(best.tolist(), top.tolist(), strict=True)]
                rest = [batch.column(i).slice(first, end - first) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(np.minimum(top, 1.0))], names=[*keys, "lang_pred", "score"])

    shown = F.when(has_letter(F.col("text")), F.col("text")).otherwise("")
    return small_batches(docs.select(shown.alias("__shown"), *keys)).mapInArrow(run, schema)
