"""Near-duplicate join on word shingles: a size-aware heavy-light set similarity join.

A document's set: the distinct runs of `WORDS` words; with fewer words, the whole sequence; no words: empty. Sets link
when their Jaccard similarity is at least 3/4, that is 7 * common >= 3 * (sum of sizes).

1. Equal sets are one node, known by a 64-bit hash of the set; each task passes a set on once.
2. Shingles get one global order, rare ones first: by the count of their bucket among 2**22, over all documents, then by
   hash. Two linked sets share one of the first n - ceil(3n/4) + 1 shingles of each, and two of one more than those.
3. Light sets, up to a boundary size, are keyed by all pairs (the fixed-size subsets) of these first shingles, heavy
   sets by the single ones: they scan the shingles' inverted lists, into which light sets go where a heavy one can reach
   them. The boundary minimises the expected cost over the size histogram.
4. Candidates are sets that share a key and whose sizes, and places in the order, let them link. First each set is compared with one leader: that which stands first in most of its lists. The links found
   give components. Then, list by list, all candidates that are still in different components are compared. So copies
   in any number take one comparison each, and no link between components is missed.
5. Comparison is by the sets' 64-bit shingle hashes.

Null and empty texts have the empty set: n_shingles 0, linked with nothing. Repeated rows come out each, and link as
equal sets do. Rows without doc_id link with equal sets only, and have no component_id unless such a row has one.
Extra columns are not returned. Rows of one doc_id with several texts are linked only if their sets are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vexel.llm.components import components
from vexel.llm.session import shared_dir, small, small_batches, written
from vexel.llm.sketch import bucket, bucket_counts
from vexel.llm.words import U64, mix, shingles, text_chunks, word_hashes

WORDS, BITS, SKETCH = 5, 22, 2048


def sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Each text's shingle hashes, sorted and distinct."""
    values, offsets = shingles(*word_hashes(texts), words)
    return [np.unique(values[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]


def node_of(s: np.ndarray) -> int:
    """A hash of the set, as signed long."""
    with np.errstate(over="ignore"):
        both = np.array([np.sum(mix(s), dtype=U64), U64(len(s))], U64)
    return int(mix(mix(both[:1]) ^ both[1:]).view(np.int64)[0])


def _rows(columns: dict[str, np.ndarray | list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if isinstance(v, np.ndarray) and v.dtype == U64 else v) for v in columns.values()], names=list(columns))


def nodes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, node (null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, texts in text_chunks(batch, 0):
                found = sets(texts, words)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, end - first), pa.array([len(s) for s in found], pa.int64()), pa.array([node_of(s) if len(s) else None for s in found], pa.int64())], names=["doc_id", "n_shingles", "node"])

    return small_batches(docs.select("text", F.col("doc_id").cast("long"))).mapInArrow(run, "doc_id long, n_shingles long, node long")


def new_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(node, set) of the texts (first column), once for each set in these batches; sets of one or two link only with equals."""
    seen: set[int] = set()
    for batch in batches:
        for _, _, texts in text_chunks(batch, 0):
            for s in sets(texts, words):
                if len(s) > 2 and (node := node_of(s)) not in seen:
                    seen.add(node)
                    yield node, s


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts of buckets on a scale of 64 steps."""
    return np.minimum(63, 2 * np.log2(counts + 1.0)).astype(np.uint8)


def boundary(sizes: dict[int, int], counts: np.ndarray) -> int:
    """The largest light size: the one with the least cost of subsets, list entries and expected list lengths."""
    order = np.sort(counts[counts > 0])
    weight = np.cumsum(order)
    quarter = int(order[np.searchsorted(weight, weight[-1] / 4)]) if len(order) else 0
    # The first shingles are among the rarest quarter; what its buckets hold beyond the mean is one shingle's list.
    length = 1 + max(0.0, quarter - counts.mean())
    singles = {s: s - (3 * s + 3) // 4 + 1 for s in sizes}

    def cost(b: int) -> float:
        return sum(n * ((singles[s] + 1) * singles[s] / 2 if s <= b else 0) + n * (singles[s] * (1 + length) if 4 * b < 4 * s or 4 * (b + 1) <= 4 * s * 4 / 3 else 0) for s, n in sizes.items())

    return min(range(2, 65), key=lambda b: (cost(b), b))


def keyed(node: int, order: np.ndarray, light: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set whose ordered shingles are given, and the place that bounds what can still be common behind each."""
    n = len(order)
    p = n - (3 * n + 3) // 4 + 1
    keys, places = [], []
    if n <= light:
        a, b = np.triu_indices(min(n, p + 1), 1)
        keys.append(mix(mix(order[a]) ^ order[b]) | U64(1))
        places.append(b - 1)  # two are common up to place b: as many as one up to place b - 1 leaves room for
    if n > light or 4 * n >= 3 * (light + 1):
        keys.append(order[:p] << U64(1))
        places.append(np.arange(p))
    return np.concatenate(keys), np.concatenate(places)


def entries(docs: DataFrame, level: np.ndarray, light: int, words: int = WORDS) -> DataFrame:
    """key, node, meta (size << 32 | place): the lists in which the sets can meet."""
    now = docs.sparkSession.sparkContext.broadcast(level)  # 2**BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, own, metas, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return _rows({"key": np.concatenate(keys), "node": np.repeat(np.array([o for o, _ in own], np.int64), [c for _, c in own]), "meta": np.concatenate(metas).astype(np.int64)})

        for node, s in new_sets(batches, words):
            ordered = np.sort(now.value[bucket(s, BITS)].astype(U64) << U64(58) | s >> U64(6))
            k, places = keyed(node, ordered, light)
            keys.append(k)
            own.append((node, len(k)))
            metas.append((len(s) << 32) + places)
            size += len(k)
            if size > 200_000:
                yield flush()
                keys, own, metas, size = [], [], [], 0
        if size:
            yield flush()

    return docs.select("text").mapInArrow(run, "key long, node long, meta long")


def may_link(n: str, place: str, m: str, other: str):
    """Whether the places let two sets of one list link; true at the first common key of sets that do."""
    rest = F.least(F.col(n) - F.col(place), F.col(m) - F.col(other))
    return rest * 7 >= (F.col(n) + F.col(m)) * 3


def lists(found: DataFrame) -> DataFrame:
    """Entries of the lists with two or more sets, with each list's leader: the set whose place is nearest to its start."""
    size, place = F.shiftright("meta", 32), F.col("meta").bitwiseAND(F.lit(0xFFFFFFFF))
    whole = Window.partitionBy("key").orderBy("rank", "node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = found.withColumn("rank", place / size)
    out = out.select("key", "node", size.alias("n"), place.alias("place"), F.first("node").over(whole).alias("leader"), F.first("meta").over(whole).alias("lead"), F.min("node").over(whole).alias("lo"), F.max("node").over(whole).alias("hi"))
    return out.where("lo != hi").drop("lo", "hi")


def common(a: np.ndarray, b: np.ndarray) -> int:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH bits: the parity of the shingles that fall on each. Two sets differ in at least as many shingles as their sketches in bits."""
    return (np.bincount((mix(s) >> U64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH) & 1).astype(bool)


def _sets_of(docs: DataFrame, wanted: DataFrame, reps: DataFrame, words: int, bits: bool) -> DataFrame:
    """node, n and data (the set's hashes, or its sketch) of the wanted nodes, from one document of each (reps: node, doc_id).

    A written table: both ends of the pairs are joined from it by plain shuffles, which adaptive execution splits where one
    leader has many members.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.binary())], names=["node", "n", "data"])

        for node, s in new_sets(batches, words):
            data = np.packbits(sketch(s)).tobytes() if bits else s.tobytes()
            held.append((node, len(s), data))
            size += len(data)
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        yield flush()

    ids = reps.join(small(wanted, 1_000_000), "node", "left_semi").select("doc_id").distinct()
    texts = docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).join(small(ids, 1_000_000), "doc_id", "left_semi").select("text")
    return written(texts.mapInArrow(emit, "node long, n long, data binary"), "sets")


def _ends(pairs: DataFrame, name: str) -> DataFrame:
    return written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), name)


def verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs (a, b of nodes) whose sets link.

    Sets that link differ in a seventh of the sum of their sizes at most; pairs whose sketches differ in more bits go
    first, so that few whole sets move.
    """

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            differ = np.concatenate([np.bitwise_count(x[i : i + 4096] ^ y[i : i + 4096]).sum(axis=1) for i in range(0, len(x), 4096)])
            keep = 7 * differ.astype(np.int64) <= batch.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), U64), np.frombuffer(right[i].as_buffer(), U64)
                keep.append(7 * common(x, y) >= 3 * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def met(asked: DataFrame, known: DataFrame) -> DataFrame:
        left, right = (known.select(F.col("node").alias(c), F.col("data").alias(f"{c}_data"), F.col("n").alias(f"{c}_n")) for c in ("a", "b"))
        return left.join(small(asked, 1_000_000), "a").join(right, "b").select("a", "b", "a_data", "b_data", (F.col("a_n") + F.col("b_n")).alias("n"))

    asked = written(pairs, "pairs")
    likely = written(met(asked, _sets_of(docs, _ends(asked, "ends"), reps, words, True)).mapInArrow(close, "a long, b long").distinct(), "likely")
    return met(likely, _sets_of(docs, _ends(likely, "ends"), reps, words, False)).mapInArrow(test, "a long, b long").distinct()


def _cross(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates of different components, (a, b), list by list; rows come sorted by key, size, node."""

    def pairs(key: np.ndarray, n: np.ndarray, node: np.ndarray, place: np.ndarray, comp: np.ndarray) -> Iterator[pd.DataFrame]:
        new = np.ones(len(key), bool)  # several tasks may have passed on a set
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, n, node, place, comp = (x[new] for x in (key, n, node, place, comp))
        at, step, out, held = np.arange(len(key)), 0, [], 0
        while len(at):
            step += 1
            at = at[at + step < len(key)]
            to = at + step
            on = (key[to] == key[at]) & (4 * n[at] >= 3 * n[to])
            at, to = at[on], to[on]
            new = (comp[at] != comp[to]) & (7 * np.minimum(n[at] - place[at], n[to] - place[to]) >= 3 * (n[at] + n[to]))
            out.append(np.stack([np.minimum(node[at[new]], node[to[new]]), np.maximum(node[at[new]], node[to[new]])]))
            held += out[-1].shape[1]
            if held > 500_000 or not len(at):
                a, b = np.concatenate(out, axis=1)
                yield pd.DataFrame({"a": a, "b": b}).drop_duplicates()
                out, held = [], 0

    rest = None
    for f in frames:
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        if not len(f):
            continue
        key = f["key"].to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        rest = f.iloc[last:]
        yield from pairs(*(f[c].to_numpy()[:last] for c in ("key", "n", "node", "place", "component")))
    if rest is not None:
        yield from pairs(*(rest[c].to_numpy() for c in ("key", "n", "node", "place", "component")))


def links(docs: DataFrame, sizes: dict[int, int], reps: DataFrame, words: int = WORDS) -> DataFrame:
    """Edges (a, b of nodes) that join just the nodes that links join: no link between components is missing."""
    counts = bucket_counts(docs, lambda texts: shingles(*word_hashes(texts), words)[0], BITS)
    light = boundary(sizes, counts)
    met = written(lists(entries(docs, levels(counts), light, words)), "lists")
    led = met.where("node != leader").withColumns({"m": F.shiftright("lead", 32), "other": F.col("lead").bitwiseAND(F.lit(0xFFFFFFFF))})
    led = led.where((F.least("n", "m") * 4 >= F.greatest("n", "m") * 3) & may_link("n", "place", "m", "other")).groupBy("node", "leader").agg(F.count("*").alias("times"))
    best = led.groupBy("node").agg(F.max_by("leader", F.struct("times", "leader")).alias("leader"))
    near = written(verified(docs, best.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), reps, words), "links")
    first = written(components(near), "components")
    joined = met.join(small(first, 1_000_000), "node", "left").select("key", "node", "n", "place", F.coalesce("component", "node").alias("component"))
    # Only lists with sets of several components go on; minima are taken in each task first, so that a list of copies burdens none.
    several = written(joined.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key"), "several")
    mixed = joined.join(several, "key", "left_semi")
    cross = mixed.repartition("key").sortWithinPartitions("key", "n", "node").mapInPandas(_cross, "a long, b long").distinct()
    more = written(verified(docs, cross, reps, words), "links")
    return near.unionByName(more)


def join(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links lead to, for every row."""
    shared_dir(docs.sparkSession)
    all_nodes = written(nodes(docs, words), "nodes")
    binned = F.when(F.col("n_shingles") <= 128, F.col("n_shingles")).otherwise(F.pow(1.25, F.ceil(F.log("n_shingles") / F.log(F.lit(1.25)))).cast("long"))
    sizes = {r["n"]: r["count"] for r in all_nodes.where("n_shingles > 2").groupBy(binned.alias("n")).count().collect()}
    least = all_nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    if sizes:
        reps = written(least.select("node", F.col("least").alias("doc_id")), "reps")
        least = reps.withColumnRenamed("doc_id", "least")
        comp = written(components(links(docs, sizes, reps, words)), "components")
        joined = least.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
        least = joined.join(smallest, "component").select("node", "component_id")
    else:
        least = least.withColumnRenamed("least", "component_id")
    return all_nodes.join(least, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
