"""Substring dedup with a compressed FM-index per shard.

A window of 50 words goes to the shard of its least 20-gram hash, so equal windows meet in a shard whatever documents they
are in. Neighbouring windows with the same least hash travel as one segment. A shard holds distinct segments as word codes
in a wavelet matrix over their Burrows-Wheeler transform. Segments are streamed through backward search, which gives their
matching statistics; a window counts if 50 words match and the interval has a segment of a smaller document, the least owner
of which another wavelet matrix tells. Segments of a key too frequent for a shard are indexed in several and searched in each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.llm import scan, scratch
from crashlens.llm.wavelet import WaveletMatrix

U64 = np.uint64
WINDOW = 50
GRAM = 20
#: Segments of a shard, about.
SHARD = 4096


class Below:
    """Nearest places of values below a bound: minima of aligned runs of 1, 2, 4 ... bytes, two bytes a value in all."""

    def __init__(self, values: np.ndarray):
        """The first value is below all bounds that are asked for."""
        self.runs = [values]
        while len(self.runs[-1]) > 1:
            v = self.runs[-1]
            v = np.append(v, v[-1:]) if len(v) % 2 else v
            self.runs.append(np.minimum(v[::2], v[1::2]))

    def last(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each place the last one up to it whose value is below the bound."""
        end = at + 1
        level = np.full(len(at), len(self.runs))
        for k, run in enumerate(self.runs):  # up, until a run holds the place
            odd = np.flatnonzero((level > k) & ((end >> k) & 1 == 1))
            held = run[(end[odd] >> k) - 1] < bound[odd]
            level[odd[held]] = k
            end[odd[~held]] -= 1 << k
        for k in range(len(self.runs) - 2, -1, -1):  # down, into its right half unless that holds none
            i = np.flatnonzero(level > k)
            end[i[self.runs[k][(end[i] >> k) - 1] >= bound[i]]] -= 1 << k
        return end - 1


class FMIndex:
    """Matching statistics over rows of word codes (from 1), by backward search; each row has an owner.

    Held: the Burrows-Wheeler transform and the owners of suffixes in their order as wavelet matrices, and the
    lengths that neighbouring suffixes have in common as bytes.
    """

    def __init__(self, rows: list[np.ndarray], owners: np.ndarray, depth: int):
        """Suffixes are sorted by their first words, more than depth of them; matches have depth words at most, of 200 at most."""
        if depth > 200:
            raise ValueError("windows of more than 200 words")
        sizes = np.array([len(x) + 1 for x in rows])
        text = np.zeros(int(sizes.sum()) + 1, np.int64)  # zeros part rows
        at = np.cumsum(sizes) - sizes
        for x, i in zip(rows, at.tolist(), strict=True):
            text[i : i + len(x)] = x
        n = len(text)
        rank, h, ranks = text.copy(), 1, []
        while True:
            ranks.append(np.append(rank, -1).astype(np.int32))
            after = np.zeros(n, np.int64)
            after[: n - h] = rank[h:] + 1
            key = rank * (n + text.max() + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.ones(n, bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            h *= 2
            if h > depth or new.all():
                break
        self.n, self.depth = n, depth
        self.tree = WaveletMatrix.build(text[order - 1])
        top = 1 << self.tree.bits
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top))))
        self.known = np.diff(self.first) > 0
        codes = np.arange(top)
        self.zero = self._down(codes, np.zeros(top, np.int64))
        self.values, own = np.unique(np.append(np.repeat(owners, sizes), np.iinfo(np.int64).max)[order], return_inverse=True)
        self.owners = WaveletMatrix.build(own)
        # words in common with the suffix before, depth at most; none at either end
        common, x, y = np.zeros(n - 1, np.int64), order[:-1].copy(), order[1:].copy()
        for i in range(len(ranks) - 1, -1, -1):
            same = np.where(ranks[i][x] == ranks[i][y], 1 << i, 0)
            common, x, y = common + same, x + same, y + same
        common[~new[1:]] = depth
        self.common = np.concatenate(([0], np.minimum(common, depth), [0])).astype(np.uint8)
        self.before, self.behind = Below(self.common), Below(self.common[::-1].copy())
        self.full = np.flatnonzero(self.common < depth - 1)

    def _down(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.tree.bits):
            ones = self.tree._ones(level, at)
            at = np.where((codes >> (self.tree.bits - 1 - level)) & 1 == 1, self.tree.zeros[level] + ones, at - ones)
        return at

    def step(self, codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with a word put before them; empty for words that no row has."""
        fine = codes < len(self.known)
        fine[fine] = self.known[codes[fine]]
        codes, out = codes[fine], np.zeros((2, len(lo)), np.int64)
        both = self._down(np.concatenate((codes, codes)), np.concatenate((lo[fine], hi[fine]))) - np.tile(self.zero[codes], 2) + np.tile(self.first[codes], 2)
        out[:, fine] = both.reshape(2, -1)
        return out[0], out[1]

    def minima(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least owner in each interval, none of them empty."""
        return self.values[self.owners.least(lo, hi)]

    def statistics(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of the streams words[begin:end] how many words from it on a row has too, depth at most, and their interval.

        Streams are read from their ends, all at once. A match that can't be put a word before is cut to the longest one with a wider
        interval. A stream ends where no match of depth words can follow; words before that have 0.
        """
        match, low, high = np.zeros(len(words), np.uint8), np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        at, lo, hi, size = end - 1, np.zeros(len(begin), np.int64), np.full(len(begin), self.n), np.zeros(len(begin), np.int64)
        while True:
            live = at - begin + 1 + size >= self.depth
            live &= at >= begin
            if not live.all():
                begin, at, lo, hi, size = (x[live] for x in (begin, at, lo, hi, size))
            if not len(at):
                return match, low, high
            whole = np.flatnonzero(size == self.depth)
            if len(whole):  # the last word goes
                i = np.searchsorted(self.full, lo[whole], "right")
                lo[whole], hi[whole] = self.full[i - 1], self.full[i]
                size[whole] -= 1
            a, b = self.step(words[at], lo, hi)
            on = a < b
            lo[on], hi[on] = a[on], b[on]
            size[on] += 1
            put = at[on]
            match[put], low[put], high[put] = size[on], lo[on], hi[on]
            off = np.flatnonzero(~on)
            to = np.maximum(self.common[lo[off]], self.common[hi[off]]).astype(np.int64)
            none = size[off] == 0
            at[on] -= 1
            at[off[none]] -= 1
            size[off] = to
            lo[off[to == 0]], hi[off[to == 0]] = 0, self.n
            wider = (to > 0) & (at[off] - begin[off] + 1 + to >= self.depth)
            off, to = off[wider], to[wider]
            if len(off):
                lo[off] = self.before.last(lo[off], to)
                hi[off] = self.n - self.behind.last(self.n - hi[off], to)


def repeats(index: FMIndex, words: np.ndarray, begin: np.ndarray, windows: np.ndarray, own: np.ndarray, length: int) -> tuple[list[list[int]], np.ndarray]:
    """For each segment with so many windows (length of them at most): starts and ends in turn of the words covered by windows
    that rows with smaller owners have; and whether rows with no greater owner have its first and last window, so all its words."""
    match, low, high = index.statistics(words, begin, begin + windows + length - 1)
    ends = np.cumsum(windows)
    of = np.repeat(np.arange(len(begin)), windows)
    place = np.arange(len(of)) - np.repeat(ends - windows, windows)
    at = begin[of] + place
    found, owner = match[at] == length, np.full(len(of), np.iinfo(np.int64).max)

    def look(i: np.ndarray) -> None:
        i = i[found[i]]
        owner[i] = index.minima(low[at[i]].astype(np.int64), high[at[i]].astype(np.int64))

    look(np.unique(np.concatenate((ends - windows, ends - 1))))
    start, last = owner[ends - windows], owner[ends - 1]
    part = ~((start < own) & (last < own))  # else first and last window cover all between
    look(np.flatnonzero(part[of] & (place > 0) & (place < windows[of] - 1)))
    hit = np.flatnonzero(owner < own[of])
    new = np.ones(len(hit), bool)
    new[1:] = (of[hit[1:]] != of[hit[:-1]]) | (place[hit[1:]] > place[hit[:-1]] + length)
    out: list[list[int]] = [[] for _ in begin]
    first = np.flatnonzero(new)
    for i, a, b in zip(of[hit[first]].tolist(), place[hit[first]].tolist(), place[hit[np.append(first[1:], len(hit)) - 1]].tolist() if len(hit) else [], strict=True):
        out[i] += [a, b + length]
    return out, (start <= own) & (last <= own)


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of width values."""
    size, out = 1, g
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(g) - width + 1], out[width - size :][: len(g) - width + 1])


def _segments(column: pa.Array, window: int, gram: int):
    """Of all texts: text number, key, hash, first window and number of windows of each segment; and the words' hashes with the texts' first words."""
    data, offsets = scan.buffers(column)
    starts, ends, first = scan.spans(data, offsets)
    words = scan.hashes(data, starts, ends, lower=False)
    counts = np.diff(first)
    width = window - gram + 1
    empty = np.zeros(0, np.int64)
    if len(words) < window:
        return empty, empty.astype(U64), empty.astype(U64), empty, empty, words, first
    least = _least(scan.grams(words, gram), width)
    doc = np.repeat(np.arange(len(counts)), counts)[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + window <= first[1:][doc])
    if not len(at):
        return empty, empty.astype(U64), empty.astype(U64), empty, empty, words, first
    doc, key = doc[at], least[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    new |= since % width == 0
    run = np.flatnonzero(new)
    size = np.diff(np.append(run, len(at)))
    begin = at[run]
    up, down = scan.powers(len(words) + 1)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(scan.mix(words) * up[:-1], dtype=U64)))
    prints = scan.mix((sums[begin + size + window - 1] - sums[begin]) * down[begin] + size.astype(U64))
    return doc[run], key[run], prints, begin - first[doc[run]], size, words, first


def _rows(docs: DataFrame) -> DataFrame:
    """A row's identity is its doc_id with a hash of its text."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")


def _merged(spans: str) -> str:
    """SQL: the union of an array of (a, b), ascending."""
    return f"aggregate(array_sort({spans}), cast(array() as array<struct<a: int, b: int>>), (s, x) -> if(size(s) > 0 and x.a <= s[size(s) - 1].b, concat(slice(s, 1, size(s) - 1), array(struct(s[size(s) - 1].a as a, greatest(s[size(s) - 1].b, x.b) as b))), concat(s, array(x))))"


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, row, spans: for each document with any, places (a, b) of words that windows which also start in a smaller document cover."""
    spark = docs.sparkSession
    rows = _rows(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in scan.pieces(batch.column("text")):
                doc, key, prints, begin, size, _, _ = _segments(part, window, gram)
                own = pa.array(doc + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(own), batch.column("row").take(own), pa.array(key.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(begin.astype(np.int32)), pa.array(size.astype(np.int32))],
                    ["doc_id", "row", "key", "print", "at", "windows"],
                )

    segments = scratch.stored(rows.mapInArrow(cut, "doc_id long, row long, key long, print long, at int, windows int"), "segments")
    classes = segments.groupBy("key", "print").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = classes.groupBy("key").agg(F.min("least").alias("x"), F.max("most").alias("y"), F.count(F.lit(1)).alias("size")).where("x < y").select("key", "size")
    classes = scratch.stored(classes.join(shared, "key"), "classes")
    parts = max(32, classes.count() // SHARD)

    # words of one occurrence of each class, from its least document
    wanted = segments.join(classes.withColumnRenamed("least", "doc_id"), ["key", "print", "doc_id"])
    wanted = wanted.groupBy("key", "print", "most", "size", "doc_id").agg(F.min(F.struct("row", "at", "windows")).alias("o"))
    wanted = wanted.groupBy("doc_id", F.col("o.row").alias("row")).agg(F.collect_list(F.struct("key", "print", "most", "size", F.col("o.at").alias("at"), F.col("o.windows").alias("windows"))).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in scan.pieces(batch.column("text")):
                data, offsets = scan.buffers(part)
                starts, ends, first = scan.spans(data, offsets)
                words = scan.hashes(data, starts, ends, lower=False)
                out: dict[str, list] = {k: [] for k in ("key", "print", "least", "again", "size", "windows", "words")}
                for i, (doc, wants) in enumerate(zip(batch.column("doc_id").slice(at, len(part)).to_pylist(), batch.column("wanted").slice(at, len(part)).to_pylist(), strict=True)):
                    for w in wants:
                        a = int(first[i]) + w["at"]
                        for k, v in (("key", w["key"]), ("print", w["print"]), ("least", doc), ("again", w["most"] > doc), ("size", w["size"]), ("windows", w["windows"]), ("words", words[a : a + w["windows"] + window - 1].tobytes())):
                            out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("key", pa.int64()), ("print", pa.int64()), ("least", pa.int64()), ("again", pa.bool_()), ("size", pa.int64()), ("windows", pa.int32()), ("words", pa.binary())]))

    texts = rows.join(wanted, ["doc_id", "row"]).select("doc_id", "text", "wanted")
    found = texts.mapInArrow(fetch, "key long, print long, least long, again boolean, size long, windows int, words binary")
    spread = f"cast((size + {SHARD - 1}) div {SHARD} as int)"
    dealt = found.withColumn("home", F.expr(f"pmod(xxhash64(print), {spread})")).withColumn("part", F.explode(F.expr(f"sequence(0, {spread} - 1)"))).withColumn("shard", F.expr(f"pmod(xxhash64(key, part), {parts})"))

    def search(table: pa.Table) -> pa.Table:
        flat = [np.frombuffer(x, U64) for x in table.column("words").to_pylist()]
        sizes = np.array([len(x) for x in flat])
        _, codes = np.unique(np.concatenate(flat), return_inverse=True)
        codes = codes + 1
        begin = np.cumsum(sizes) - sizes
        windows, least = (np.asarray(table.column(k)).astype(np.int64) for k in ("windows", "least"))
        again = np.asarray(table.column("again"))
        indexed = np.flatnonzero(np.asarray(table.column("home")) == np.asarray(table.column("part")))
        out: dict[str, list] = {"key": [], "print": [], "copy": [], "spans": []}
        if len(indexed):
            index = FMIndex([codes[begin[i] : begin[i] + sizes[i]] for i in indexed.tolist()], least[indexed], window)
            keys, prints = table.column("key").to_pylist(), table.column("print").to_pylist()
            spans, whole = repeats(index, codes, begin, windows, least, window)
            found = [(i, False, x) for i, x in enumerate(spans) if x] + [(i, True, [0, int(windows[i]) + window - 1]) for i in np.flatnonzero(again & whole).tolist()]
            for i, copy, x in found:
                for k, v in (("key", keys[i]), ("print", prints[i]), ("copy", copy), ("spans", [{"a": a, "b": b} for a, b in zip(x[::2], x[1::2], strict=True)])):
                    out[k].append(v)
        return pa.Table.from_pydict(out, pa.schema([("key", pa.int64()), ("print", pa.int64()), ("copy", pa.bool_()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))]))

    spans = "array<struct<a: int, b: int>>"
    hits = dealt.select("shard", "home", "part", "key", "print", "least", "again", "windows", "words").groupBy("shard").applyInArrow(search, f"key long, print long, copy boolean, spans {spans}")
    placed = segments.join(hits.join(classes.select("key", "print", "least"), ["key", "print"]), ["key", "print"]).where("copy = (doc_id > least)")
    placed = placed.select("doc_id", "row", F.expr("transform(spans, x -> struct(x.a + at as a, x.b + at as b))").alias("spans"))
    return placed.groupBy("doc_id", "row").agg(F.expr(_merged("flatten(collect_list(spans))")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept, the words that stay, joined by one space.

    Null and blank texts have no words; rows without doc_id are left out; rows that repeat a doc_id aren't smaller than each other.
    """
    rows = _rows(docs)
    joined = rows.join(repeated_spans(docs, window, gram), ["doc_id", "row"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in scan.pieces(batch.column("text")):
                data, offsets = scan.buffers(part)
                starts, ends, first = scan.spans(data, offsets)
                gone = np.zeros(len(starts) + 1, np.int64)
                for i, spans in enumerate(batch.column("spans").slice(at, len(part)).to_pylist()):
                    for s in spans or ():
                        gone[first[i] + s["a"]] += 1
                        gone[first[i] + s["b"]] -= 1
                stay = np.cumsum(gone[:-1]) == 0
                raw, kept = data.tobytes(), []
                for i in range(len(part)):
                    a, b = first[i], first[i + 1]
                    kept.append(b" ".join([raw[x:y] for x, y in zip(starts[a:b][stay[a:b]].tolist(), ends[a:b][stay[a:b]].tolist(), strict=True)]))
                removed = np.concatenate(([0], np.cumsum(~stay)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(part)), pa.array(np.diff(first)), pa.array(np.diff(removed[first])), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode() for x in kept], pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(scratch.table(spark, sf_dir, "documents")).drop("kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS g FROM d, unnest(range(1, len(w) - 48)) AS t(k)),
f AS (SELECT g, min(doc_id) AS least FROM p GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, x FROM p JOIN f USING (g), unnest(range(k, k + 50)) AS t(x) WHERE doc_id > least),
r AS (SELECT doc_id, list(x) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
             array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' ') AS kept FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM k
"""
