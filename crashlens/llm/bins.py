"""First-fit decreasing packing with a tournament tree, in randomised groups of documents.

Texts are cut into full pieces, which are sequences already, and one rest each. Rests are dealt at random into groups of bounded
size; a group is packed on its own, longest rest first, into the first sequence with room, which a tournament tree over the
rooms finds. The tokens of the emptiest sequences then fill what room the others have left, and what remains of a group is cut
into powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.llm import scratch
from crashlens.llm.tokens import encoder, public

#: Rests of a group, about.
GROUP = 4096


class Tournament:
    """Room of bins in order of opening; each inner node holds the larger room of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.size)

    def first(self, need: int) -> int:
        """The first bin with that much room. With as many bins as pieces there is one."""
        at = 1
        while at < self.size:
            at *= 2
            at += self.room[at] < need
        return at - self.size

    def take(self, bin_: int, amount: int) -> None:
        at = bin_ + self.size
        self.room[at] -= amount
        while at > 1:
            at //= 2
            most = max(self.room[2 * at], self.room[2 * at + 1])
            if self.room[at] == most:
                break
            self.room[at] = most


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of places of lengths, longest first; equal lengths keep their order."""
    tree, out = Tournament(len(lengths), capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = tree.first(n)
        tree.take(at, n)
        if at == len(out):
            out.append([])
        out[at].append(i)
    return out


def level(bins: list[list[int]], lengths: np.ndarray, capacity: int, slack: int) -> list[list[tuple[int, int, int]]]:
    """Bins as slices (piece, from, to) with little padding: a bin has at most `slack` tokens of room or a power of two in all.

    The fullest bins stay and take tokens of the emptiest ones where they have more room than that.
    """
    rest = sorted(bins, key=lambda b: -sum(int(lengths[i]) for i in b))
    out = [[(i, 0, int(lengths[i])) for i in b] for b in rest]
    fill = [sum(int(lengths[i]) for i in b) for b in rest]
    first, last = 0, len(out) - 1
    while first < last:
        room = capacity - fill[first]
        if room <= slack:
            first += 1
            continue
        i, a, b = out[last].pop()
        take = min(room, b - a)
        out[first].append((i, a, a + take))
        if take < b - a:
            out[last].append((i, a + take, b))
        fill[first] += take
        fill[last] -= take
        if not fill[last]:
            last -= 1
    out, fill = out[: last + 1], fill[: last + 1]
    if out and capacity - fill[-1] > slack and fill[-1] & (fill[-1] - 1):  # the one that is left over
        left, n = out.pop(), fill[-1]
        while left:
            room, part = 1 << n.bit_length() - 1, []
            n -= room
            while room:
                i, a, b = left.pop()
                take = min(room, b - a)
                part.append((i, a, a + take))
                if take < b - a:
                    left.append((i, a + take, b))
                room -= take
            out.append(part)
    return out


def cut(docs: DataFrame, path: str, end_id: int, capacity: int, width: int) -> DataFrame:
    """Pieces of whole texts, closed by end_id: full ones and a rest for each text, with ids of so many bytes."""
    schema = "doc_id long, start long, length long, doc_tokens long, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            flat, offsets = coder.encode(batch.column("text").to_pylist())
            sizes = np.diff(offsets) + 1
            ids = np.insert(flat, offsets[1:], end_id).astype(f"<u{width}").tobytes()
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(capacity, sizes[row] - start)
            ends = pa.array(np.append(0, np.cumsum(length)) * width, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()).take(pa.array(row)), *(pa.array(x.astype(np.int64)) for x in (start, length, sizes[row])),
                 pa.Array.from_buffers(pa.large_binary(), len(row), [None, ends.buffers()[1], pa.py_buffer(ids)]).cast(pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


OUT = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_groups(docs: DataFrame, capacity: int = 2048, path: str | None = None, end_id: int = 1, group: int = GROUP, slack: int = 0) -> DataFrame:
    """A row per piece of each row's text (doc_id, text): doc_id, start, length, doc_tokens, sequence_id, offset and ids, little-endian
    unsigned 32-bit integers.

    Sequences have at most `capacity` tokens, at most `slack` fewer, or a power of two: with no slack nothing is padded. A text that
    fits is cut only where its sequence is given up to fill others. A null or empty text is its end id alone. Rows with a null or
    repeated doc_id are packed like others; no rows give no pieces. Memory goes with a group, never with the input.
    """
    if capacity < 1 or group < 1 or slack < 0:
        raise ValueError("capacity and group are at least 1, slack at least 0")
    path = path or public("word_bpe_49k.json")
    width = 2 if max(encoder(path).library.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
    dealt = cut(docs, path, end_id, capacity, width).withColumn("_deal", F.xxhash64("doc_id", "start", F.monotonically_increasing_id()))  # equal rows go apart too
    pieces = scratch.stored(dealt, "pieces")
    rests = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rests.count() // group))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("_deal", "ascending")])
        length, start, raw = table["length"].to_numpy(), table["start"].to_numpy(), table["ids"].to_pylist()
        rows = []
        for sequence, parts in enumerate(level(first_fit_decreasing(length, capacity), length, capacity, slack)):
            offset = 0
            for i, a, b in parts:
                rows.append((i, int(start[i]) + a, b - a, key[0].as_py() << 32 | sequence, offset, np.frombuffer(raw[i], f"<u{width}")[a:b].astype("<u4").tobytes()))
                offset += b - a
        at, *columns = zip(*rows, strict=True) if rows else ([],) * 6
        own = table.take(pa.array(at, pa.int64()))
        kinds = [pa.int64()] * 4 + [pa.binary()]
        starts, sizes, sequences, offsets, ids = (pa.array(x, t) for x, t in zip(columns, kinds, strict=True))
        return pa.table([own["doc_id"], starts, sizes, own["doc_tokens"], sequences, offsets, ids], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), ids], names=[*batch.schema.names[:6], "ids"])

    packed = rests.withColumn("_group", F.pmod("_deal", F.lit(groups))).groupBy("_group").applyInArrow(pack, OUT)
    whole = pieces.where(F.col("length") == capacity).select("doc_id", "start", "length", "doc_tokens", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    return packed.unionByName(whole.mapInArrow(widen, OUT))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all `documents` in sequences of 2048. Nulls, repeats and empty tables as in pack_groups()."""
    out = pack_groups(scratch.table(spark, sf_dir, "documents"))
    return out.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
