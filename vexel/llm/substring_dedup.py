"""Substring deduplication by sliding sentence spans.

Sentences: the words of a text are cut where a sentence or line ends, so that no piece is longer than `window` words and few
are shorter than half of it. Among any `window` words in a row, the first word of a sentence is a cut, or where there is none, any
word; of several, the one whose hash, over the words next to it, is smallest. So short sentences are taken together,
long ones are parted, and equal passages are cut alike wherever they stand, but for up to `window` words at both ends.

Spans: every run of `run` such sentences, known by a 64-bit hash of its lower-cased words. Spans with equal hashes are joined
over the whole corpus. The document with the smallest doc_id keeps a span; in all others, and in the same one at later places, it
is repeated. Sentences covered by repeated spans are removed where at least `least_words` words in a row are covered: so a
passage of `least_words` + 2 * `window` words or more is always removed, up to its ends, and a short formula never is.

Null texts stay null and take no part; texts without words have no sentences. Rows with equal doc_id and text are treated alike, and
rows with equal doc_id and different texts don't repeat each other. Rows without doc_id lose nothing but what they repeat themselves.
Texts of any length are read whole. Extra columns stay as they are, but for those named n_sentences and n_removed. The empty table
gives the empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.llm.session import small, small_batches, written
from vexel.llm.words import U64, mix, power_tables

RUN, WINDOW, LEAST_WORDS = 3, 8, 38
CHUNK_CHARS = 1 << 18
SPACE, WORD, SOLID, STOP, END = 1, 2, 3, 4, 5
#: Scripts without spaces between words, each of whose letters counts as a word.
_SOLID = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: A sentence ends after one of the first with white space behind, and after any of the second.
_STOPS, _ENDS = ".!?…", "\n。！？．｡؟۔।॥։።။។"


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, its class (0: any other) and its lower case."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x20000):
        c = chr(i)
        if c.isalnum():
            kind[i] = WORD
            low = c.lower()
            lower[i] = ord(low) if len(low) == 1 else i
        elif c.isspace():
            kind[i] = SPACE
    for a, b in _SOLID:
        kind[a : b + 1] = np.where((kind[a : b + 1] == WORD) | (a >= 0x20000), SOLID, kind[a : b + 1])
    kind[[ord(c) for c in _STOPS]] = STOP
    kind[[ord(c) for c in _ENDS]] = END
    return kind, lower


def _least(v: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """The least (or what pick picks) of each `width` values in a row."""
    done = 1
    while done < width:
        step = min(done, width - done)
        v = pick(v[:-step], v[step:])
        done += step
    return v


class Sentences:
    """The sentences of some texts: for each its first word and first character, by text; and the words' hashes."""

    def __init__(self, texts: list[str], window: int = WINDOW):
        kind_of, lower_of = _letters()
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        kind = kind_of[codes]
        after = np.append(kind[1:], np.uint8(END))
        before = np.insert(kind[:-1], 0, np.uint8(END))
        self.starts = np.flatnonzero((kind == SOLID) | (kind == WORD) & (before != WORD))
        ends = np.flatnonzero((kind == SOLID) | (kind == WORD) & (after != WORD)) + 1
        n = len(self.starts)
        #: Where each text's words begin, one more than texts.
        self.words = np.searchsorted(self.starts, begins)
        powers, inverse = power_tables(max(len(codes), n) + 1)
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(lower_of[codes].astype(U64) + U64(1)) * powers[: len(codes)])])
        hashes = mix((total[ends] - total[self.starts]) * inverse[self.starts])
        self.total = np.concatenate([np.zeros(1, U64), np.cumsum(hashes * powers[:n])])
        self.inverse = inverse
        breaks = np.cumsum((kind == END) | (kind == STOP) & ((after == SPACE) | (after == END)))
        first = np.ones(n, bool)
        if n:
            first[1:] = breaks[self.starts[1:]] > breaks[ends[:-1] - 1]
        counts = np.diff(self.words)
        new = self.words[:-1][counts > 0]
        following = np.concatenate([hashes[1:], hashes[-1:]])
        following[self.words[1:][counts > 0] - 1] = 0
        ahead = mix(hashes * U64(3) + mix(following))
        rank = np.where(first, ahead >> U64(1), mix(mix(np.concatenate([hashes[:1], hashes[:-1]])) + ahead) >> U64(1) | U64(1 << 63))
        rank[new] = 0
        # A place of rank 0 stands behind each text, so that what follows it in the batch doesn't matter.
        place = np.arange(n) + np.repeat(np.arange(len(texts)), counts)
        padded = np.zeros(n + len(texts) + 2 * window, U64)
        padded[place] = rank
        around = np.zeros(window - 1, U64)
        cut = (_least(np.concatenate([around, _least(padded, window), around]), window, np.maximum) == padded)[place]
        cut[new] = True
        #: First word of each sentence, and where each text's sentences begin.
        self.cuts = np.flatnonzero(cut)
        self.offsets = np.searchsorted(self.cuts, self.words)

    def text_of(self) -> np.ndarray:
        """The number of each sentence's text."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def sizes(self) -> np.ndarray:
        """Words of each sentence."""
        return np.diff(np.append(self.cuts, len(self.starts)))

    def spans(self, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first sentence within it, and hash of each span; and whether the text has an equal one before it."""
        text = self.text_of()
        at = np.arange(len(text))
        at = at[at + run <= self.offsets[text + 1]]
        text = text[at]
        ends = np.append(self.cuts, len(self.starts))[at + run]
        starts = self.cuts[at]
        h = mix(mix((self.total[ends] - self.total[starts]) * self.inverse[starts]) + (ends - starts).astype(U64))
        order = np.lexsort((at, h, text))
        again = np.zeros(len(at), bool)
        again[order[1:]] = (text[order[1:]] == text[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
        return text, at - self.offsets[text], h, again


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts (null: empty) of about CHUNK_CHARS: number of the first, texts."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS or i + 1 == len(texts):
            yield first, [x or "" for x in texts[first : i + 1]]
            first, size = i + 1, 0


def _version():
    """Tells apart rows that share a doc_id: 31 bits of the text's hash."""
    return F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF))


def span_rows(docs: DataFrame, run: int = RUN, window: int = WINDOW) -> DataFrame:
    """h, doc, place (version << 32 | first sentence): the different spans of each row that has a text and a doc_id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, texts in _chunks(batch.column(2).to_pylist()):
                text, at, h, again = Sentences(texts, window).spans(run)
                text, at, h = first + text[~again], at[~again], h[~again]
                for i in range(0, len(h), 100_000):
                    j = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(h[j].view(np.int64)), pa.array(ids[text[j]]), pa.array(versions[text[j]] << 32 | at[j])], names=["h", "doc", "place"])

    rows = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), _version().alias("version"), "text")
    return small_batches(rows).mapInArrow(work, "h long, doc long, place long")


def repeated(docs: DataFrame, run: int = RUN, window: int = WINDOW) -> DataFrame:
    """doc, version, cover: for each row with spans that a document with a smaller id has, their first sentences as [first, end), flattened."""
    # Minima are taken in each task first, so that a span in a third of all documents weighs no more than others; the join's
    # two sides are plain shuffles, which adaptive execution splits where one span has many rows.
    first = written(span_rows(docs, run, window).groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("h", "first"), "spans")
    later = span_rows(docs, run, window).join(first, "h").where("doc > first")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column(2):
                at = np.unique(places.values.to_numpy())
                new = np.flatnonzero(np.diff(at, prepend=-2) > 1)
                out.append(np.stack([at[new], at[np.append(new[1:], len(at)) - 1] + 1], axis=1).ravel() if len(at) else at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["doc", "version", "cover"])

    of_doc = later.select("doc", F.shiftright("place", 32).alias("version"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at")).groupBy("doc", "version").agg(F.collect_list("at").alias("at"))
    return of_doc.mapInArrow(merge, "doc long, version long, cover array<int>")


def _removed(sentences: Sentences, covers: list, run: int, least_words: int) -> np.ndarray:
    """For each sentence, whether it goes. covers: by text, [first, end) of repeated spans' first sentences, flattened."""
    n = len(sentences.cuts)
    text, at, _, again = sentences.spans(run)
    drop = np.zeros(n + 1, np.int64)
    own = sentences.offsets[text[again]] + at[again]
    np.add.at(drop, own, 1)
    np.add.at(drop, own + run, -1)
    for i, cover in enumerate(covers):
        if cover is not None:
            begin, end = sentences.offsets[i], sentences.offsets[i + 1]
            a, b = np.asarray(cover).reshape(-1, 2).T
            np.add.at(drop, np.minimum(begin + a, end), 1)
            np.add.at(drop, np.minimum(begin + b + run - 1, end), -1)
    out = np.cumsum(drop)[:-1] > 0
    text = sentences.text_of()
    new = np.ones(n, bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    stretch = np.cumsum(new) - 1
    return out & (np.bincount(stretch, weights=sentences.sizes(), minlength=1)[stretch] >= least_words) if n else out


def dedup(docs: DataFrame, run: int = RUN, window: int = WINDOW, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with their remaining text, and columns n_sentences, n_removed (both int)."""
    cover = written(repeated(docs, run, window), "covers").toDF("__doc", "__of", "__cover")
    kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    marked = docs.select(*kept, F.col("doc_id").cast("long").alias("__id"), _version().alias("__version"))
    joined = marked.join(small(cover, 1_000_000), (F.col("__id") == F.col("__doc")) & (F.col("__version") == F.col("__of")), "left").select(*kept, "__cover")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, covers = batch.column(batch.schema.get_field_index("text")).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            texts, total, removed = [], [], []
            for first, part in _chunks(old):
                found = Sentences(part, window)
                out = _removed(found, covers[first : first + len(part)], run, least_words)
                begins = np.cumsum([0, *(len(t) + 1 for t in part)])
                count = np.bincount(found.text_of(), weights=out, minlength=len(part)).astype(np.int64)
                total += np.diff(found.offsets).tolist()
                removed += count.tolist()
                for i, text in enumerate(part):
                    if not count[i]:
                        texts.append(old[first + i])
                        continue
                    a, b = found.offsets[i], found.offsets[i + 1]
                    at = [0, *(found.starts[found.cuts[a + 1 : b]] - begins[i]).tolist(), len(text)]
                    texts.append("".join(text[at[k] : at[k + 1]] for k in np.flatnonzero(~out[a:b]).tolist()))
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names[:-1])} | {"text": pa.array(texts, pa.string()), "__n": pa.array(total, pa.int32()), "__r": pa.array(removed, pa.int32())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = T.StructType([*joined.schema.fields[:-1], T.StructField("__n", T.IntegerType()), T.StructField("__r", T.IntegerType())])
    return small_batches(joined).mapInArrow(work, schema).withColumnsRenamed({"__n": "n_sentences", "__r": "n_removed"})
