"""Best-fit packing of token pieces into sequences of a fixed capacity.

The plan depends on the histogram of lengths alone, capacity counters at most. Lengths and the sums of pairs are indexed; single
lengths, then pairs, then triples (a length and an indexed pair) that fill a gap exactly are consumed as often as availability
counts allow; what is left goes to the open sequence with the smallest gap that takes it. A piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashlens.llm import scratch
from crashlens.llm.tokens import crc32, encoder, public


#: Different lengths up to which all their pairs are indexed.
LENGTHS = 4096


class Sums:
    """Sums of available lengths: single ones, pairs by their sum, and triples as a length and a pair of the rest.

    Availability only falls, so an entry that is used up never comes back and each is passed over once. With more than LENGTHS
    different lengths, whose pairs would take too much memory, a sum's pairs are found among the lengths when they are asked
    for, in the same order.
    """

    def __init__(self, left: np.ndarray, capacity: int):
        self.left = left
        v = np.flatnonzero(left[:capacity])
        self.begin = None
        if len(v) > LENGTHS:
            have = (left[: capacity + 1] > 0).astype(float)
            have[capacity] = 0
            sums = np.fft.irfft(np.fft.rfft(have, 4 * capacity) ** 2, 4 * capacity)[: capacity + 1]
            self.some = sums > 0.5  # pairs of a sum that there were at first
            return
        firsts, seconds = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for a in v.tolist():
            fits = v[(v >= a) & (v < capacity - a)]
            firsts.append(np.full(len(fits), a, np.int32))
            seconds.append(fits.astype(np.int32))
        a, b = np.concatenate(firsts), np.concatenate(seconds)
        sums = a.astype(np.int32) + b
        order = np.argsort(sums, kind="stable")
        self.a, self.b = a[order], b[order]  # the more even pairs of a sum last
        self.begin = np.searchsorted(sums[order], np.arange(capacity + 1))
        self.end = np.append(self.begin[1:], len(a))
        self.some = self.begin < self.end

    def free(self, length: int, used: tuple[int, ...]) -> int:
        return int(self.left[length]) - used.count(length)

    def pair(self, total: int, used: tuple[int, ...]) -> tuple[int, int] | None:
        """Two available lengths with that sum, besides those that are used already; the most even ones first."""
        if self.begin is None:
            a = np.arange(total // 2, 0, -1)
            fit = a[(self.left[a] > 0) & (self.left[total - a] > (2 * a == total))] if self.some[total] else a[:0]
            self.some[total] = len(fit) > 0
            return next(((total - x, x) for x in fit.tolist() if self.free(x, used) > 0 and self.free(total - x, (*used, x)) > 0), None)
        while self.some[total]:
            i = int(self.end[total]) - 1
            a, b = int(self.a[i]), int(self.b[i])
            if self.left[a] and self.left[b] and (a != b or self.left[a] > 1):
                break
            self.end[total] = i
            self.some[total] = self.begin[total] < i
        for i in range(int(self.end[total]) - 1, int(self.begin[total]) - 1, -1):
            a, b = int(self.a[i]), int(self.b[i])
            if self.free(a, used) > 0 and self.free(b, (*used, a)) > 0:
                return b, a
        return None

    def triple(self, total: int, used: tuple[int, ...]) -> tuple[int, int, int] | None:
        """Three available lengths with that sum: the longest whose rest is the sum of a pair."""
        x = np.arange(total - 2, 0, -1)
        for length in x[(self.left[x] > 0) & self.some[total - x]].tolist():
            if self.free(length, used) > 0 and (found := self.pair(total - length, (*used, length))):
                return length, *found
        return None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how many sequences have each; counts[length] pieces, lengths from 1 to capacity."""
    left, out = counts.astype(np.int64).copy(), []
    sums = Sums(left, capacity)

    def take(pattern: tuple[int, ...]) -> None:
        kinds, need = np.unique(pattern, return_counts=True)
        times = int((left[kinds] // need).min())
        if times:
            left[kinds] -= need * times
            out.append((pattern, times))

    if left[capacity]:
        take((capacity,))
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        if left[length] and sums.free(gap, (length,)) > 0:
            take((length, gap))
        for more in (sums.pair, sums.triple):
            while left[length] and (found := more(gap, (length,))):
                take((length, *found))
    # best fit of the rest, longest first
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        while left[length]:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = int(fits[0]) + length
                pattern, n = open_[gap].pop()
                gaps[gap] = bool(open_[gap])
                times = min(n, int(left[length]))
                if n > times:
                    open_.setdefault(gap, []).append((pattern, n - times))
                    gaps[gap] = True
            else:
                pattern, gap, fit = (), capacity, capacity // length
                times = max(1, int(left[length]) // fit) if left[length] >= fit else 1
                add = min(fit, int(left[length]))
                left[length] -= add * times
                gap -= add * length
                open_.setdefault(gap, []).append(((length,) * add, times))
                gaps[gap] = True
                continue
            left[length] -= times
            gap -= length
            open_.setdefault(gap, []).append(((*pattern, length), times))
            gaps[gap] = True
    return out + [x for xs in open_.values() for x in xs]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Intervals of ranks by length: pieces with length and rank in [rank, next) go to sequence + (their rank - rank) at offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "rank", "sequence", "offset"))}


#: Columns that packing uses inside.
INSIDE = ("_bucket", "_n", "_base", "_own", "_rank")


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """Numbers the pieces of each length from 0 in column _rank.

    Pieces of a length are dealt to hash buckets, ranked within one and moved by the counts of the buckets before it, so
    a length that most pieces have isn't sorted in one task. Equal pieces take their ranks in any order.
    """
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id() % 64), F.lit(buckets)))
    salted = scratch.stored(salted, "salted")
    counts = salted.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("_own", F.row_number().over(own)).join(counts, ["length", "_bucket"]).withColumn("_rank", F.col("_base") + F.col("_own") - 1).drop("_bucket", "_own", "_base")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset, which replace columns of these names, to pieces: doc_id, piece, length from 1 to capacity, ids_crc32.

    Other columns stay, but those named as in INSIDE go. No pieces give no rows; null ids and equal rows are pieces like others.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop(*INSIDE)
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # capacity rows at most
        counts[length] = n
    table = places(plan(counts, capacity))
    shared, kept = spark.sparkContext.broadcast(table), [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = t["length"] << 40 | t["rank"]
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)).astype(np.int64) for k in ("length", "_rank"))
            at = np.searchsorted(keys, length << 40 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(t["sequence"][at] + rank - t["rank"][at]), pa.array(t["offset"][at])],
                [*(f.name for f in kept), "sequence_id", "offset"],
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "sequence_id long, offset long"])
    return ranked(pieces, max(32, int(counts.sum()) // 200_000)).select(*(f"`{f.name}`" for f in kept), "_rank").mapInArrow(place, schema)


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Token pieces of whole texts, closed by end_id (null text: empty); only longer documents are cut."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            flat, offsets = coder.encode(batch.column("text").to_pylist())
            rows = []
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                ids = np.append(flat[offsets[i] : offsets[i + 1]], end_id)
                rows += [(doc, k, at, min(capacity, len(ids) - at), crc32(ids[at : at + capacity])) for k, at in enumerate(range(0, len(ids), capacity))]
            a, b, c, d, e = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(a, pa.int64()), "piece": pa.array(b, pa.int32()), "start": pa.array(c, pa.int64()),
                "length": pa.array(d, pa.int32()), "ids_crc32": pa.array(e, pa.int64()),
            })

    return docs.select("doc_id", "text").mapInArrow(encode, PIECES)


def pack_documents(docs: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int = 1) -> DataFrame:
    """A row per piece of each row's text (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece with the end id alone. Rows with a null or repeated doc_id are packed like others; no rows
    give no pieces. A text of any length is cut into as many pieces as it needs. The plan is made on the driver, from at most `capacity` counters.
    """
    pieces = scratch.stored(cut(docs, path or public("word_bpe_49k.json"), end_id, capacity), "pieces")
    return pack(pieces, capacity).withColumns({"length": F.col("length").cast("long")})


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all `documents` in sequences of 4096. Nulls, repeats and empty tables as in pack_documents()."""
    return pack_documents(scratch.table(spark, sf_dir, "documents"))
