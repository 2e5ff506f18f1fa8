"""Token estimates, templates and chunkers.

The chunkers are Python helpers behind a pandas UDF, since the place of a cut depends on the cut before; everything else is
column expressions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.operators.shared import small_batches

#: Texts are cut and embedded about so many characters at a time.
BATCH_CHARS = 1 << 20

#: Context sizes by model name, in tokens; fixed values.
CONTEXT = {"gpt-3.5-turbo": 4096, "gpt-4": 8192, "gpt-4-32k": 32768, "claude-2": 100000, "claude-instant": 100000, "llama-2-7b": 4096, "llama-2-13b": 4096, "llama-2-70b": 4096}


def tokens_by_length(text: Column | str) -> Column:
    """(characters + 3) / 4, cut."""
    return F.floor((F.length(text) + 3) / 4).cast("long")


def tokens_by_words(text: Column | str) -> Column:
    """words * 1.3, cut, and one for each punctuation mark."""
    c = F.col(text) if isinstance(text, str) else text
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return (F.floor(words * 1.3) + F.regexp_count(c, F.lit(r"[\p{Punct}]"))).cast("long")


def context_size(model: Column) -> Column:
    """A model's context, 4096 where unknown."""
    found = F.lit(4096)
    for name, size in CONTEXT.items():
        found = F.when(model == name, size).otherwise(found)
    return found


def response_size(model: Column) -> Column:
    """A quarter of the context is the response's."""
    return F.floor(context_size(model) / 4)


def fill(template: str, **values: Column) -> Column:
    """The template with {name} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def cut_fixed(text: str, longest: int = 1000, overlap: int = 200, shortest: int = 100) -> list[tuple[int, str]]:
    """Chunks of at most `longest` characters that end at a sentence's end if one lies within 100 characters of the limit.

    Chunks overlap by `overlap` (at most half a chunk); those shorter than `shortest` are dropped, unless it is the only one.
    """
    overlap = min(overlap, longest // 2)
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + longest)
        if end < len(text):
            ends = [m.end() for m in re.finditer(r"[.!?](?=\s)|\n", text[max(start + 1, end - 100) : end])]
            if ends:
                end = max(start + 1, end - 100) + ends[-1]
        out.append((start, text[start:end]))
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    kept = [(a, t) for a, t in out if len(t) >= shortest]
    return kept or out[:1]


def cut_paragraphs(text: str, longest: int = 1000, overlap: int = 200, shortest: int = 100) -> list[tuple[int, str]]:
    """Paragraphs (blank lines between them) packed into chunks; longer ones are cut as by cut_fixed.

    A chunk begins with as many of the last paragraphs of the one before as have at most `overlap` characters together.
    """
    parts, at = [], 0
    for m in [*re.finditer(r"\n\s*\n", text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            parts.append((at, end))
        at = m.end() if m else end
    out: list[tuple[int, str]] = []
    held: list[tuple[int, int]] = []  # paragraphs of the chunk that is being packed
    fresh = False  # whether any of them isn't in the chunk before

    def close() -> None:
        nonlocal fresh
        if fresh:
            out.append((held[0][0], text[held[0][0] : held[-1][1]]))
        fresh = False

    for a, b in parts:
        if b - a > longest:
            close()
            held = []
            out += [(a + s, t) for s, t in cut_fixed(text[a:b], longest, overlap, shortest)]
            continue
        if held and b - held[0][0] > longest:
            close()
            while held and (held[-1][1] - held[0][0] > overlap or b - held[0][0] > longest):
                held.pop(0)
        held.append((a, b))
        fresh = True
    close()
    return [(a, t) for a, t in out if len(t) >= shortest] or out[:1]


def cut_recursive(text: str, longest: int = 1000, overlap: int = 200, shortest: int = 100, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[tuple[int, str]]:
    """Splits by the first separator that occurs, packs the parts, and splits parts that are still too long by the next."""

    def go(a: int, b: int, level: int) -> list[tuple[int, int]]:
        if b - a <= longest:
            return [(a, b)]
        if level == len(separators):
            return [(a + s, a + s + len(t)) for s, t in cut_fixed(text[a:b], longest, overlap, 1)]
        sep, cuts, at = separators[level], [], a
        while (k := text.find(sep, at, b)) >= 0:
            cuts.append(k + len(sep))
            at = k + len(sep)
        edges = [a, *cuts, b] if not cuts or cuts[-1] < b else [a, *cuts]
        if len(edges) == 2:
            return go(a, b, level + 1)
        out: list[tuple[int, int]] = []
        for x, y in zip(edges, edges[1:], strict=False):
            if y - x > longest:
                out += go(x, y, level + 1)
            elif out and y - out[-1][0] <= longest and out[-1][1] == x:
                out[-1] = (out[-1][0], y)
            else:
                out.append((x, y))
        return out

    found = [(a, text[a:b]) for a, b in go(0, len(text), 0)] if text else []
    return [(a, t) for a, t in found if len(t.strip()) >= shortest] or found[:1]


#: Own chunkers, token estimators and embedders are functions of these kinds.
Chunker = Callable[[str, int, int, int], list[tuple[int, str]]]
TokenEstimator = Callable[[Column | str], Column]
Embedder = Callable[[list[str]], "np.ndarray"]
CHUNKERS = {"fixed": cut_fixed, "paragraphs": cut_paragraphs, "recursive": cut_recursive}


def chunk(docs: DataFrame, strategy: str | Chunker = "fixed", longest: int = 1000, overlap: int = 200, shortest: int = 100, id_col: str = "doc_id", text: str = "text", tokens: TokenEstimator = tokens_by_length) -> DataFrame:
    """id, chunk (from 0), chunks, start, end, content, tokens of each document; null and empty texts have none.

    The strategy is a name or any function of (text, longest, overlap, shortest) that gives (start, content) of the chunks.
    """
    cut = CHUNKERS[strategy] if isinstance(strategy, str) else strategy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            schema = pa.schema([batch.schema.field(0), *own])
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                t = text.as_py()
                found = cut(t, longest, overlap, shortest) if t else []
                for i, (a, c) in enumerate(found):
                    held.append((name.as_py(), len(found), i, a, c))
                    size += len(c)
                    if size >= BATCH_CHARS or len(held) >= 10_000:
                        yield made()
                        held, size = [], 0
        if held:
            yield made()

    own = [pa.field("chunks", pa.int32()), pa.field("chunk", pa.int32()), pa.field("start", pa.int32()), pa.field("content", pa.string())]
    picked = small_batches(docs).select(id_col, F.col(text).cast("string").alias("__text"))
    kinds = T.StructType([picked.schema[0], *(T.StructField(n, k) for n, k in (("chunks", T.IntegerType()), ("chunk", T.IntegerType()), ("start", T.IntegerType()), ("content", T.StringType())))])
    rows = picked.mapInArrow(run, kinds)
    return rows.select(id_col, "chunk", "chunks", "start", (F.col("start") + F.length("content")).alias("end"), "content", tokens("content").alias("tokens"))


def chunk_estimate(text: Column | str, strategy: str = "fixed", longest: int = 1000, overlap: int = 200) -> Column:
    """About how many chunks a text will have."""
    n = F.length(text)
    if strategy == "fixed":
        return F.when(n <= longest, F.least(n, F.lit(1))).otherwise(F.ceil((n - overlap) / float(longest - min(overlap, longest // 2))))
    return F.greatest(F.least(n, F.lit(1)), F.ceil(n / float(longest)))


def word_buckets(texts: list[str], dimension: int = 64, positional: float = 0.0) -> np.ndarray:
    """(texts, dimension): each word (letters and digits) adds one to the bucket of its MD5; then scaled to length 1; texts without words: 0.

    With `positional`, that weight over 1 + the word's place is added to the bucket after it, so that order counts.
    """
    buckets: dict[str, int] = {}
    out = np.zeros((len(texts), dimension))
    for row, t in zip(out, texts, strict=True):
        words = re.findall(r"[^\W_]+", t.lower())
        for w in set(words).difference(buckets):
            buckets[w] = int.from_bytes(hashlib.md5(w.encode(), usedforsecurity=False).digest()[:4]) % dimension
        at = np.array([buckets[w] for w in words], np.int64)
        row += np.bincount(at, minlength=dimension)
        if positional and len(at):
            row += np.bincount((at + 1) % dimension, weights=positional / (1.0 + np.arange(len(at))), minlength=dimension)
        row /= np.sqrt((row * row).sum()) or 1.0
    return out


def embedding(text: Column | str, embed: Embedder) -> Column:
    """Texts to vectors by any function of a list of texts, some texts at a time; null for null."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        held: list[str] = []
        size, out = 0, []

        def done() -> None:
            out.extend(np.asarray(v, float) for v in embed(held))

        have = texts.is_valid()
        for text in texts.filter(have):
            held.append(text.as_py())
            size += len(held[-1])
            if size >= BATCH_CHARS:
                done()
                held, size = [], 0
        if held:
            done()
        lengths = np.zeros(len(texts) + 1, np.int32)
        lengths[1:][have.to_numpy(zero_copy_only=False)] = [len(v) for v in out]
        values = pa.array(np.concatenate(out) if out else np.zeros(0))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), values, mask=pa.compute.invert(have))

    small_batches()
    return run(text)


def hashed_embedding(text: Column | str, dimension: int = 64, positional: float = 0.0) -> Column:
    """A text's embedding by word_buckets. Deterministic."""
    return embedding(text, lambda texts: word_buckets(texts, dimension, positional))


def embed_distinct(docs: DataFrame, text: str, embed: Embedder, name: str = "vector") -> DataFrame:
    """The rows with their text's vector; a text that many rows share is embedded once. Null texts have none."""
    known = docs.select(text).where(F.col(text).isNotNull()).distinct().select(F.xxhash64(text).alias("__h"), F.md5(text).alias("__m"), embedding(text, embed).alias(name))
    keyed = docs.withColumns({"__h": F.xxhash64(text), "__m": F.md5(text)})
    return keyed.join(known, ["__h", "__m"], "left").select(*docs.columns, name)


def word_set(text: Column | str) -> Column:
    """The different words of a text, between white space, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != ""))


def set_jaccard(x: Column, y: Column) -> Column:
    """Shared elements over all elements of two arrays without repeats; 1 for two empty ones."""
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def word_jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared words over all words of two texts; 1 for two empty ones."""
    return set_jaccard(word_set(a), word_set(b))
