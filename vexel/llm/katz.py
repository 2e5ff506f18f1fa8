"""Katz backoff over a whole corpus: all n-grams counted, discounted and looked up in tables partitioned by context.

Events are the distinct training tokens (words of vexel.llm.words, and an end after each text) and one for all unknown words.
P(w) = d(c) c / N, with the Good-Turing discount d of counts up to 5; the mass that it frees is the unknown word's. For longer
n-grams P(w|h) = d(c) c(hw) / c(h), with d by length, and for pairs not seen a(h) P(w|h'), h' being h without its first word; a(h)
makes the sum over all events exactly one. Where nothing is left for other words, c(h) counts one more. No n-gram is left out,
at any corpus size. Words are known by 64-bit hashes.

* Texts are read once, in blocks of about BLOCK tokens, each a row of a written table. A block asks for each n-gram that it
  holds once, whatever its number there, and says how often its training texts hold it. So copies and frequent n-grams
  weigh little, and a part gets at most one entry of an n-gram from a block.
* Level by level (words, then pairs, then triples), requests are dealt to parts by context. A part adds up the counts of its
  n-grams, and answers each block with its n-grams' counts; where one was never seen after a known context, also with what the
  context's backoff weight is made of. A context with a large share of all tokens is dealt by the whole n-gram, and the parts'
  sums for it, one row each, are added up.
* Words get numbers in order of their counts, by runs of equal counts, so that a number tells its count; n-grams are kept as
  numbers, and compressed.
* With all answers, and the discounts of the corpus, each block evaluates its tokens recursively, from the longest context on.

Null texts count as empty: their one token is the end. Repeated rows are scored, and learned, each. Without any training
text all mass is the unknown word's. Texts of any length are read whole, each in one block. Extra columns stay, but for those of the results' names.
"""

from __future__ import annotations

import gc
import io
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.llm.session import new_path, removed, small_batches, written
from vexel.llm.words import U64, mix, text_chunks, word_hashes

END = U64(0x1D8AF0C3E5B79264)
ORDER, DISCOUNTED, BLOCK, PART_BYTES = 3, 5, 1_000_000, 7_000_000
RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
MESSAGE = "level int, part int, block long, a long, b long, data binary"
#: What rows of an answer table are.
ANSWER, COUNTS, HOT = 0, 1, 2


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words with an end behind each text, and where each text begins."""
    words, offsets = word_hashes(texts)
    n = len(texts)
    out = np.empty(len(words) + n, U64)
    ends = offsets[1:] + np.arange(n)
    out[ends] = END
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = words
    return out, offsets + np.arange(n + 1)


def good_turing(total: int, of_counts: dict[int, int], k: int = DISCOUNTED) -> tuple[list[float], float]:
    """Discounts of the counts 1 to k, and the mass they free; none, and 1 / (total + 1), where the counts don't allow it."""
    n = [of_counts.get(r, 0) for r in range(k + 2)]
    if total and n[1] and all(n[1 : k + 2]):
        a = (k + 1) * n[k + 1] / n[1]
        d = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if a < 1 else 0 for r in range(1, k + 1)]
        if all(0 < x <= 1 for x in d):
            return d, n[1] / total
    return [], 1 / (total + 1)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, byte plane by byte plane, without the planes that are empty in all, compressed."""
    out = io.BytesIO()
    for a in arrays:
        a = np.ascontiguousarray(a, dtype="<u8")
        planes = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        out.write(len(a).to_bytes(8, "little") + bytes([planes]))
        out.write(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T[:planes]).tobytes())
    raw = out.getvalue()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n, planes = int.from_bytes(raw[at : at + 8], "little"), raw[at + 8]
        a = np.zeros((n, 8), np.uint8)
        a[:, :planes] = np.frombuffer(raw, np.uint8, n * planes, at + 9).reshape(planes, n).T
        out.append(a.view("<u8").ravel())
        at += 9 + n * planes
    return out


def falls(values: np.ndarray, parts: int) -> np.ndarray:
    """The part of each well-mixed value: equal ranges, so that sorted values are sorted by part."""
    return ((values >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["level", "part", "block", "a", "b", "data"])


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in sorted_columns], axis=0)
    return np.flatnonzero(new)


def _name(context: list[np.ndarray]) -> np.ndarray:
    """One number for each context."""
    name = context[0]
    for c in context[1:]:
        name = mix(name) + c
    return name


@dataclass
class Figures:
    """What all tasks know of the corpus: sizes, discounts by length, and the first number of each run of words with equal counts."""

    parts: int
    total: int = 0
    distinct: int = 0
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    discount: list[list[float]] = field(default_factory=list)
    unknown: float = 1.0
    #: By length from 2 on: the backoff parts of contexts that are spread over parts.
    hot: list[dict] = field(default_factory=list)

    def count(self, ids: np.ndarray) -> np.ndarray:
        """How often the training texts hold the words with these numbers."""
        return self.counts[np.searchsorted(self.first, ids, "right") - 1]

    def word_prob(self, ids: np.ndarray) -> np.ndarray:
        c = self.count(ids)
        return np.where(c > 0, self.shares(1, c) / (self.total if self.discount[0] else self.total + 1), self.unknown)

    def shares(self, n: int, c: np.ndarray) -> np.ndarray:
        """d(c) c."""
        d = np.asarray([1.0, *self.discount[n - 1]])
        return c * d[np.where(c <= len(self.discount[n - 1]), c, 0)]

    def crowded(self, c: np.ndarray) -> np.ndarray:
        """Whether contexts with so many tokens are dealt by n-gram."""
        return (c > self.total // (4 * self.parts)) & (self.parts > 1)

    def weights(self, n: int, c: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For contexts with count c: the size that shares are divided by, and the backoff weight.

        sums: (contexts, DISCOUNTED + 1), how many n-grams have each small count, and the lower probabilities' sum.
        """
        small = sums[:, :DISCOUNTED]
        r = np.arange(1, DISCOUNTED + 1)
        used = c - small @ r + small @ (r * np.asarray(self.discount[n - 1] or [1.0] * DISCOUNTED))
        size = np.where(used > (1 - 1e-9) * c, c + 1, c)
        return size, (1 - used / size) / np.maximum(1 - sums[:, DISCOUNTED], 1e-12)

    def sizes(self, n: int, c: np.ndarray, full: np.ndarray) -> np.ndarray:
        """What the shares of a context's n-grams are divided by: one more than its count where nothing else is left for other words."""
        return c + (full if self.discount[n - 1] else 1)


def read_blocks(docs: DataFrame, learn: Column, keep: list[str], parts: int, block: int = BLOCK) -> DataFrame:
    """Blocks (level 0, with the rows' other columns) and their requests for words (level 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        hashes: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        learnt: list[np.ndarray] = []
        rest: list[pa.RecordBatch] = []
        size = 0

        def close() -> pa.RecordBatch:
            all_hashes, sizes, flags = np.concatenate(hashes), np.concatenate(lengths), np.concatenate(learnt)
            words, at = np.unique(all_hashes, return_inverse=True)
            times = np.bincount(at, weights=np.repeat(flags, sizes), minlength=len(words)).astype(U64)
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, rest[0].schema) as stream:
                for b in rest:
                    stream.write_batch(b)
            rows = [(0, -1, number, 0, 0, packed(at, sizes, flags), sink.getvalue())]
            cuts = np.searchsorted(falls(words, parts), np.arange(parts + 1))
            for p in range(parts):
                if cuts[p] < cuts[p + 1]:
                    own = words[cuts[p] : cuts[p + 1]]
                    rows.append((1, p, number, 0, 0, packed(np.diff(own, prepend=U64(0)), times[cuts[p] : cuts[p + 1]]), None))
            hashes.clear(), lengths.clear(), learnt.clear(), rest.clear()
            table = _table([r[:6] for r in rows]).append_column("rest", pa.array([r[6] for r in rows], pa.binary()))
            return table.combine_chunks().to_batches()[0]

        for batch in batches:
            others = pa.RecordBatch.from_arrays([batch.column(i) for i in range(2, batch.num_columns)], names=keep)
            for first, end, texts in text_chunks(batch, 0):
                h, offsets = tokens(texts)
                hashes.append(h)
                lengths.append(np.diff(offsets))
                learnt.append(batch.column(1).slice(first, end - first).to_numpy(zero_copy_only=False).astype(np.int64))
                rest.append(others.slice(first, end - first))
                size += len(h)
                if size >= block:
                    yield close()
                    number, size = number + 1, 0
        if size:
            yield close()

    picked = docs.select("text", F.coalesce(learn, F.lit(False)).alias("__learn"), *keep)
    return small_batches(picked).mapInArrow(run, MESSAGE + ", rest binary")


def _count_words(parts: int):
    """A part of level 1: answers (count, place among its words with that count), and how many words have each count."""

    def run(table: pa.Table) -> pa.Table:
        part, blocks = table.column("part")[0].as_py(), table.column("block").to_pylist()
        asked = [unpacked(d) for d in table.column("data").to_pylist()]
        words = [np.cumsum(a[0], dtype=U64) for a in asked]
        both = np.concatenate(words)
        order = np.argsort(both, kind="stable")
        start = _starts(both[order])
        distinct, total = both[order][start], np.add.reduceat(np.concatenate([a[1] for a in asked])[order], start)
        by_count = np.argsort(total, kind="stable")
        run_start = _starts(total[by_count])
        sizes = np.diff(np.append(run_start, len(total)))
        place = np.empty(len(total), U64)
        place[by_count] = np.arange(len(total)) - np.repeat(run_start, sizes)
        rows = [(ANSWER, part, b, 0, 0, packed(total[at], place[at])) for b, at in zip(blocks, (np.searchsorted(distinct, w) for w in words), strict=True)]
        return _table(rows + [(COUNTS, part, 0, int(c), int(n), None) for c, n in zip(total[by_count][run_start], sizes, strict=True)])

    return run


def _count_grams(n: int, now):
    """A part of level n: answers 2 * count + (whether the context is full), and for n-grams not seen what the weight is made of."""

    def run(table: pa.Table) -> pa.Table:
        f: Figures = now.value
        part, blocks = table.column("part")[0].as_py(), table.column("block").to_pylist()
        asked = [unpacked(d) for d in table.column("data").to_pylist()]
        for a in asked:
            a[0] = np.cumsum(a[0], dtype=U64)
        sizes = [len(a[0]) for a in asked]
        columns = [np.concatenate(c) for c in zip(*asked, strict=True)]
        context, word, times = columns[: n - 1], columns[n - 1], columns[n].astype(np.int64)
        order = np.lexsort((word, _name(context)))
        context, word, times, crowd = [c[order] for c in context], word[order], times[order] >> 1, (times[order] & 1).astype(bool)
        start = _starts(*context, word)
        gram = np.cumsum(np.bincount(start, minlength=len(word))) - 1
        total = np.add.reduceat(times, start)
        context, word, crowd = [c[start] for c in context], word[start], crowd[start]
        if n == 2:
            lower = f.word_prob(word)
        else:
            code = columns[n + 1].astype(np.int64)[order][start]
            lower = f.shares(n - 1, code >> 1) / np.maximum(f.sizes(n - 1, f.count(context[-1]), code & 1), 1)
        begin = _starts(*context)
        owner = np.cumsum(np.bincount(begin, minlength=len(word))) - 1
        seen = total > 0
        sums = np.zeros((len(begin), DISCOUNTED + 1))
        for r in range(1, DISCOUNTED + 1):
            sums[:, r - 1] = np.bincount(owner[total == r], minlength=len(begin))
        sums[:, DISCOUNTED] = np.bincount(owner[seen], weights=lower[seen], minlength=len(begin))
        value = 2 * total + ~sums[:, :DISCOUNTED].any(axis=1)[owner]
        found = [(COUNTS, part, 0, r, int((total == r).sum()), None) for r in range(1, DISCOUNTED + 2)] + [(COUNTS, part, 0, 0, int(total.sum()), None)]
        place = np.empty(len(order), np.int64)
        place[order] = gram
        for b, at in zip(blocks, np.split(place, np.cumsum(sizes)[:-1]), strict=True):
            miss = at[total[at] == 0]
            parts_of = sums[owner[miss]]
            found.append((ANSWER, part, b, 0, 0, packed(value[at], *parts_of[:, :DISCOUNTED].T.astype(U64), np.ascontiguousarray(parts_of[:, DISCOUNTED]).view(U64))))
        # Contexts of which other parts hold n-grams as well.
        for i in np.flatnonzero(crowd[begin]).tolist():
            ids = [int(c[begin[i]]) for c in context]
            found.append((HOT, part, 0, ids[0], ids[-1], sums[i].tobytes()))
        return _table(found)

    return run


@dataclass
class Block:
    """A block's tokens as word numbers, and what the answers say of its n-grams."""

    ids: np.ndarray
    rank: np.ndarray  # each token's word among the block's, by number
    first: np.ndarray  # the place of each token in its text
    sizes: np.ndarray
    flags: np.ndarray
    rest: bytes
    #: By length from 2 on: for each token, the number of the n-gram that ends there (-1: none); for each n-gram, its count and
    #: whether its context is full; and for those not seen, in order, what their contexts' weights are made of.
    grams: list[np.ndarray] = field(default_factory=list)
    answers: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def requests(self, n: int, f: Figures) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The distinct n-grams, sorted, as columns (numbers, training texts' times, for triples the lower pair's answer); parts; order by part."""
        at = np.flatnonzero(self.first >= n - 1)
        head = self.rank[at - 1] if n == 2 else self.grams[n - 3][at - 1]
        key, first, back = np.unique(head * (int(self.rank.max(initial=0)) + 1) + self.rank[at], return_index=True, return_inverse=True)
        place = np.full(len(self.ids), -1, np.int64)
        place[at] = back
        self.grams.append(place)
        end = at[first]
        columns = [self.ids[end - i] for i in range(n - 1, -1, -1)]
        times = np.bincount(back, weights=np.repeat(self.flags, self.sizes)[at], minlength=len(key)).astype(U64)
        columns.append(times)
        if n == 2:
            known = f.count(columns[0])
        else:
            pair = self.grams[n - 3]
            count, full = self.answers[n - 3][:2]
            known = count[pair[end - 1]]
            columns.append((2 * count[pair[end]] + full[pair[end]]).astype(U64))
        crowd = f.crowded(known)
        columns[n] = 2 * times + crowd
        name = _name(columns[: n - 1])
        part = falls(mix(mix(np.where(crowd, mix(mix(name) + columns[n - 1]), name))), f.parts)
        # N-grams are in order already, as pairs and words are.
        return columns, part, np.argsort(part.astype(np.uint16) if f.parts < 1 << 16 else part, kind="stable")

    def answered(self, n: int, f: Figures, columns: list[np.ndarray], order: np.ndarray, data: list[bytes]) -> None:
        """Takes the parts' answers, in order of parts, to the requests of length n."""
        got = [unpacked(d) for d in data]
        value = np.empty(len(order), np.int64)
        value[order] = np.concatenate([g[0] for g in got]).astype(np.int64)
        count, full = value >> 1, value & 1
        missed = order[(count == 0)[order]]
        sums = np.empty((len(missed), DISCOUNTED + 1))
        sums[:, :DISCOUNTED] = np.concatenate([np.stack(g[1 : DISCOUNTED + 1], axis=1) for g in got])
        sums[:, DISCOUNTED] = np.concatenate([g[DISCOUNTED + 1].view(np.float64) for g in got])
        if f.hot[n - 2]:
            names, table = f.hot[n - 2]
            head = _name(columns[: n - 1])
            at = np.minimum(np.searchsorted(names, head), len(names) - 1)
            hit = names[at] == head
            full[hit] = ~table[:, :DISCOUNTED].any(axis=1)[at[hit]]
            sums[hit[missed]] = table[at[missed]][hit[missed]]
        self.answers.append((count, full, missed, sums))


def _open(table: pa.Table, f: Figures, upto: int) -> Block:
    """The block of a group of rows (itself, and answers by level), with the answers up to a length."""
    rows = {}
    for level, part, data in zip(*(table.column(c).to_pylist() for c in ("level", "part", "data")), strict=True):
        rows.setdefault(level, []).append((part, data))
    ordered = {level: [d for _, d in sorted(found, key=lambda x: x[0])] for level, found in rows.items()}
    at, sizes, flags = (a.astype(np.int64) for a in unpacked(ordered[0][0]))
    runs = np.append(f.counts, -1)
    named = []
    for part, data in sorted(rows[1], key=lambda x: x[0]):
        total, place = unpacked(data)
        slot = np.searchsorted(-runs[:-1], -total.astype(np.int64))
        named.append(f.first[slot] + place * U64(f.parts) + U64(part))
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    rest = next(x for x in table.column("rest").to_pylist() if x is not None)
    words = np.concatenate(named)
    order = np.argsort(words)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    block = Block(words[at], rank[at], np.arange(len(at)) - np.repeat(begin, sizes), sizes, flags, rest)
    for n in range(2, upto + 1):
        columns, _, order = block.requests(n, f)
        if len(order):
            block.answered(n, f, columns, order, ordered[n])
        else:
            none = np.zeros(0, np.int64)
            block.answers.append((none, none, none, np.zeros((0, DISCOUNTED + 1))))
    return block


def _ask(n: int, now):
    def run(table: pa.Table) -> pa.Table:
        f: Figures = now.value
        block = _open(table, f, n - 1)
        number = table.column("block")[0].as_py()
        columns, part, order = block.requests(n, f)
        part = part[order]
        cuts = np.searchsorted(part, np.arange(f.parts + 1))
        rows = []
        for p in np.unique(part).tolist():
            own = order[cuts[p] : cuts[p + 1]]
            rows.append((n, p, number, 0, 0, packed(np.diff(columns[0][own], prepend=U64(0)), *(c[own] for c in columns[1:]))))
        return _table(rows)

    return run


def _score(now, schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        f: Figures = now.value
        order = len(f.discount)
        block = _open(table, f, order)
        c = f.count(block.ids)
        logs = np.log10(f.word_prob(block.ids))
        for n in range(2, order + 1):
            gram = block.grams[n - 2]
            at = np.flatnonzero(gram >= 0)
            count, full, missed, sums = block.answers[n - 2]
            own = gram[at]
            head = c[at - 1] if n == 2 else block.answers[n - 3][0][block.grams[n - 3][at - 1]]
            hit = count[own] > 0
            yes, no = at[hit], at[~hit & (head > 0)]
            logs[yes] = np.log10(f.shares(n, count[own[hit]]) / f.sizes(n, head[hit], full[own[hit]]))
            slot = np.empty(len(count), np.int64)
            slot[missed] = np.arange(len(missed))
            logs[no] += np.log10(f.weights(n, head[~hit & (head > 0)], sums[slot[gram[no]]])[1])
        text = np.repeat(np.arange(len(block.sizes)), block.sizes)
        n = len(block.sizes)
        base = np.log10((c + 0.1) / (f.total + 0.1 * (f.distinct + 1)))
        add = lambda w: np.bincount(text, weights=w, minlength=n)
        rest = pa.ipc.open_stream(block.rest).read_all()
        new = [pa.array(block.sizes), pa.array(add(c > 0).astype(np.int64)), pa.array(np.full(n, f.total)), pa.array(add(base)), pa.array(add(logs))]
        return pa.table([*rest.columns, *new], names=[*rest.schema.names, *RESULTS]).cast(schema)

    return run


def _freed(spark: SparkSession) -> None:
    """Spark drops the shuffle files of finished jobs once the driver's JVM has collected their plans, which takes two collections.

    Asked for after each level, so that only one level's files lie on disk.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def learn_and_score(docs: DataFrame, learn: Column, order: int = ORDER, block: int = BLOCK, part_bytes: int = PART_BYTES) -> DataFrame:
    """All rows of docs, without text, with n_tokens, n_known, train_tokens, base_score and score (log10), by a model of the rows where `learn` holds."""
    if not 1 <= order <= 3:
        raise ValueError("contexts have two words at most")
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != "text" and c not in RESULTS]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    f = Figures(max(1, round(size / part_bytes)))
    path, found = new_path(spark, "blocks"), read_blocks(docs, learn, keep, f.parts, block)
    found.write.partitionBy("level").parquet(path)
    read = spark.read.schema(found.schema).parquet(path)
    blocks = read.where("level = 0")
    answers = [written(read.where("level = 1").groupBy("part").applyInArrow(_count_words(f.parts), MESSAGE), "answers")]
    removed(spark, f"{path}/level=1")  # the requests for words, which were answered
    _freed(spark)
    runs = answers[0].where(F.col("level") == COUNTS).groupBy("a").agg(F.max("b").alias("most"), F.sum("b").alias("n")).orderBy(F.desc("a")).collect()
    f.counts = np.array([r["a"] for r in runs], np.int64)
    f.first = np.concatenate([[0], np.cumsum([r["most"] * f.parts for r in runs])]).astype(U64)[:-1]
    of_counts = {r["a"]: r["n"] for r in runs}
    f.total, f.distinct = sum(c * n for c, n in of_counts.items()), sum(n for c, n in of_counts.items() if c)
    discount, f.unknown = good_turing(f.total, of_counts)
    f.discount.append(discount)

    def rows() -> DataFrame:
        told = [a.where(F.col("level") == ANSWER).select(F.lit(n).alias("level"), "part", "block", "data", F.lit(None).cast("binary").alias("rest")) for n, a in enumerate(answers, 1)]
        out = blocks.select("level", "part", "block", "data", "rest")
        for t in told:
            out = out.unionByName(t)
        return out

    for n in range(2, order + 1):
        now = spark.sparkContext.broadcast(f)
        asked = rows().groupBy("block").applyInArrow(_ask(n, now), MESSAGE)
        answers.append(written(asked.groupBy("part").applyInArrow(_count_grams(n, now), MESSAGE), "answers"))
        _freed(spark)
        counted = {r["a"]: r["n"] for r in answers[-1].where(F.col("level") == COUNTS).groupBy("a").agg(F.sum("b").alias("n")).collect()}
        f.discount.append(good_turing(counted.pop(0, 0), counted)[0])
        f.hot.append(_hot(answers[-1].where(F.col("level") == HOT), n))
    now = spark.sparkContext.broadcast(f)
    schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(c, T.LongType() if i < 3 else T.DoubleType()) for i, c in enumerate(RESULTS))])
    return rows().groupBy("block").applyInArrow(_score(now, _arrow(schema)), schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _hot(rows: DataFrame, n: int) -> tuple | None:
    """Sorted names of the crowded contexts (few: each has a share of a part's tokens at least) and their summed parts."""
    found: dict[tuple[int, int], np.ndarray] = {}
    for r in rows.select("a", "b", "data").collect():
        at = r["a"], r["b"]
        found[at] = found.get(at, 0) + np.frombuffer(r["data"])
    if not found:
        return None
    a, b = (np.array([k[i] for k in found], U64) for i in (0, 1))
    names = _name([a] if n == 2 else [a, b])
    order = np.argsort(names)
    return names[order], np.stack(list(found.values()))[order]
