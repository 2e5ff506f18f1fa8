"""Best-fit packing of tokenized documents into fixed-length sequences by hierarchical residual packing.

1. Each document becomes token ids and an end id. Only documents longer than a sequence are cut, so that all pieces but
   the first are full.
2. Full pieces are sequences. The others are dealt to groups; each group packs its pieces best-fit, longest first.
3. Bins with at most `slack` free tokens are emitted. Underfull bins go on as items, whose length is their fill, to a
   round with `fan_in` times fewer groups, and so on up to a single group. A group passes on at most `carry` bins, those
   with the most room; so no round, the last included, holds more than groups * carry items. Bins not passed on are emitted.
4. Bins of a round are pieces of the next; joins compose the places.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.session import small_batches, written

LENGTH = 2048
_encoders: dict[str, tuple] = {}


def encoder(path: str) -> tuple:
    """The byte-level BPE of a tokenizers JSON file, run by tiktoken over the same vocabulary, merge order and splits; and its added tokens.

    Their strings in a text become their ids, and part the text there, as the library does by default (a test compares the ids);
    this way is about five times as fast.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte_of = {c: b for b, c in _byte_letters().items()}
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in k): v for k, v in file["model"]["vocab"].items() if k not in added and all(c in byte_of for c in k)}
        _encoders[path] = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), added
    return _encoders[path]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(enc: tuple, text: str, step: int = 200_000) -> list[int]:
    """Ids of a text of any length."""
    plain, added = enc
    if not any(a in text for a in added):
        return _encode_long(plain, text, step)
    parts = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text)
    return [i for p in parts for i in ([added[p]] if p in added else _encode_long(plain, p, step))]


def _encode_long(plain, text: str, step: int) -> list[int]:
    """Long texts are cut where a space follows a letter, where the splitting pattern always ends a piece."""
    if len(text) <= 2 * step:
        return plain.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    while at < len(text):
        end = min(len(text), at + step)
        while end < len(text) and not (text[end] == " " and text[end - 1].isascii() and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end += 1
        ids += plain.encode_ordinary(text[at:end])
        at = end
    return ids


def tokenize(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """Pieces of the documents: doc_id, piece, start, length, ids_crc32, and with ids=True the ids themselves.

    Null texts count as empty: one piece that holds the end id alone. Rows with equal doc_id are separate documents.
    """
    path = tokenizer or default_tokenizer()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.array([*encode(enc, text or ""), end_id], dtype="<u4")
                n = len(found)
                first = n % length or length
                cuts = [0, *range(min(first, n), n + 1, length)] if n > length else [0, n]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    out.append((doc, piece, a, b - a, zlib.crc32(found[a:b].tobytes()), *([found[a:b].astype("<i4")] if ids else [])))
            names = [x.split()[0] for x in schema.split(", ")]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=False)], names=names)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return small_batches(picked).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the open bin with the least room that still fits."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[int] = []  # rooms that some open bin has, in order
    by_room: dict[int, list[int]] = {}
    made = 0
    for i in order.tolist():
        need = int(lengths[i])
        k = bisect_left(rooms, need)
        if k < len(rooms):
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[k]
        else:
            room, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - need:
            if left not in by_room:
                insort(rooms, left)
                by_room[left] = []
            by_room[left].append(b)
    return bins, offsets


def _pack_round(items: DataFrame, groups: int, length: int, slack: int, carry: int) -> DataFrame:
    """One round over (item, size): item, size, group, bin, offset, fill, goes_on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ignore_index=True)
        bins, offsets = best_fit(pdf["size"].to_numpy(), length)
        fill = np.bincount(bins, weights=pdf["size"].to_numpy()).astype(np.int64)
        room_order = np.argsort(fill, kind="stable")
        on = np.zeros(len(fill), bool)
        on[room_order[:carry]] = True
        on &= fill < length - slack
        return pdf.assign(bin=bins, offset=offsets, fill=fill[bins], goes_on=on[bins])[["item", "size", "part", "bin", "offset", "fill", "goes_on"]]

    schema = "item long, size long, part int, bin long, offset long, fill long, goes_on boolean"
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int"))
    return dealt.groupBy("part").applyInPandas(run, schema)


def pack(pieces: DataFrame, length: int = LENGTH, slack: int = 2, group_rows: int = 20_000, fan_in: int = 8, carry: int = 20_000) -> DataFrame:
    """The pieces with sequence_id and offset. Extra columns of the pieces stay, but for those of these two names.

    Every piece gets one place; no sequence exceeds `length`; places in a sequence have no gaps. The empty table gives
    the empty table.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    keyed = written(pieces.select(*names, F.monotonically_increasing_id().alias("__item")), "pieces")
    open_pieces = keyed.where(F.col("length") < length)
    groups = max(1, -(-open_pieces.count() // group_rows))
    items = open_pieces.select(F.col("__item").alias("item"), F.col("length").alias("size"))
    places = None  # for each piece that is still open: the item that holds it now, and its offset there
    closed = []
    level = 0
    while True:
        # Bins have negative numbers, unique over all rounds; pieces have numbers from 0 on.
        number = -(F.lit(level << 58) + F.shiftleft(F.col("part").cast("long"), 32) + F.col("bin") + 1)
        packed = written(_pack_round(items, groups, length, slack, carry if groups > 1 else 0).withColumn("node", number), f"round{level}")
        step = packed.select("item", "node", F.col("offset").alias("step"), "goes_on")
        if places is None:
            now = step.select(F.col("item").alias("leaf"), "node", F.col("step").alias("offset"), "goes_on")
        else:
            now = written(places.join(step, "item").select("leaf", "node", (F.col("offset") + F.col("step")).alias("offset"), "goes_on"), f"places{level}")
        closed.append(now.where(~F.col("goes_on")).select("leaf", "node", "offset"))
        if groups == 1:
            break
        items = packed.where("goes_on").groupBy("node").agg(F.sum("size").alias("size")).withColumnRenamed("node", "item")
        places = now.where("goes_on").select("leaf", F.col("node").alias("item"), "offset")
        groups, level = max(1, -(-groups // fan_in)), level + 1
    placed = reduce(DataFrame.unionByName, closed).select(F.col("leaf").alias("__item"), F.col("node").alias("__node"), F.col("offset").alias("__place"))
    joined = keyed.join(placed, "__item", "left")
    return joined.select(*names, F.coalesce("__node", "__item").alias("sequence_id"), F.coalesce("__place", F.lit(0).cast("long")).alias("offset"))
