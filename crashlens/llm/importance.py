"""Importance resampling towards a target's word n-grams, over hashed buckets.

A block of a partition's texts is a row of word ids. Its suffix array, sorted as deep as the longest n-gram, puts equal n-grams
beside each other; runs of the LCP array enumerate them. Each run is hashed once and its bucket goes to all its occurrences:
they are counted in the first pass over the texts and weighed in the second.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashlens.llm import scan, scratch

#: Bytes that part words: ASCII but for digits and letters.
SEPARATORS = np.ones(256, bool)
SEPARATORS[128:] = False
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    SEPARATORS[_a : _b + 1] = False
#: A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Bytes of text in a block, or one text.
BLOCK = 8 << 20


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words' common ids from 0, and a place of each id. Words are grouped by hash, then compared by their bytes."""
    hashed = scan.hashes(data, starts, ends, lower=False)
    _, first, ids = np.unique(hashed, return_index=True, return_inverse=True)
    sizes, model = ends - starts, starts[first][ids]
    same = bool((sizes == sizes[first][ids]).all())
    if same:
        at = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        same = bool((data[at] == data[at + np.repeat(model - starts, sizes)]).all())
    if not same:  # two words with one hash
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        _, first = np.unique(ids, return_index=True)
    return ids, first


def suffixes(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their next words, depth of them at least, and how many each has in common with the place before, at most depth.

    left: the words from a place to the end of its text; a text's end comes before any word.
    """
    rank, k = ids + 1, 1
    while k < depth:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:]
        after[left <= k] = 0
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1] + 1
        k *= 2
    order = np.argsort(rank, kind="stable")
    common, same = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    for j in range(depth):
        a, b = order[1:] + j, order[:-1] + j
        same &= (left[order[1:]] > j) & (left[order[:-1]] > j)
        same[same] = ids[a[same]] == ids[b[same]]
        common[1:] += same
    return order, common


def features(column: pa.Array, orders: int, buckets: int) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """By blocks: the first row, the n + 1 places of the texts' first words, and by n-gram length where features start and their buckets."""
    for row, part in scan.pieces(column, BLOCK):
        data, offsets = scan.buffers(part)
        starts, ends, at = scan.spans(data, offsets, SEPARATORS)
        data = LOWER[data]
        ids, first = word_ids(data, starts, ends)
        left = np.repeat(at[1:], np.diff(at)) - np.arange(len(starts))
        order, common = suffixes(ids, left, orders)
        words = [data[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        found = []
        for n in range(1, orders + 1):
            runs = np.flatnonzero(common < n)  # where one starts; texts' last words give runs that are too short
            heads = order[runs]
            full = left[heads] >= n
            grams = np.stack([ids[heads[full] + j] for j in range(n)], 1).tolist() if full.any() else []
            hashed = np.full(len(runs), -1, np.int64)
            hashed[full] = [zlib.crc32(b" ".join([words[i] for i in gram])) % buckets for gram in grams]
            spread = np.empty(len(order), np.int64)
            spread[order] = np.repeat(hashed, np.diff(np.append(runs, len(order))))
            places = np.flatnonzero(spread >= 0)
            found.append((places, spread[places]))
        yield row, at, found


def bucket_counts(docs: DataFrame, orders: int, buckets: int) -> DataFrame:
    """bucket, n: features of all texts by bucket. A task adds up all its texts first; buckets without any have no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in features(batch.column("text"), orders, buckets):
                for _, hashed in found:
                    total += np.bincount(hashed, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some])})

    return docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, orders: int, buckets: int) -> np.ndarray:
    """A thousand times the log of how much likelier each bucket is in the target, floored; counts are smoothed by one."""
    spark = docs.sparkSession
    sides = [bucket_counts(x, orders, buckets).withColumnRenamed("n", name) for x, name in ((docs, "s"), (target, "t"))]
    rows = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(sides[0], "bucket", "left").join(sides[1], "bucket", "left").fillna(0, ["s", "t"])
    table = scratch.stored(rows, "buckets")
    total = table.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    ratio = f"double(t + 1) * double({total.S}L + {buckets}) / (double(s + 1) * double({total.T}L + {buckets}))"
    out = np.zeros(buckets, np.int64)
    for bucket, gain in table.select("bucket", F.expr(f"cast(floor(1000 * ln({ratio})) as long)")).collect():  # a row for each bucket
        out[bucket] = gain
    scratch.forget(table)
    return out


def weigh(docs: DataFrame, gain: np.ndarray, orders: int) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean of the gains of a text's features, 0 for none."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n, total = (np.zeros(len(batch), np.int64) for _ in range(3))
            for row, at, found in features(batch.column("text"), orders, buckets):
                rows = slice(row, row + len(at) - 1)
                n_words[rows] = np.diff(at)
                for places, hashed in found:
                    edges = np.searchsorted(places, at)
                    n[rows] += np.diff(edges)
                    total[rows] += np.diff(np.concatenate(([0], np.cumsum(shared.value[hashed])))[edges])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").cast(pa.int64()), "n_words": pa.array(n_words),
                "n_features": pa.array(n), "weight": pa.array(np.where(n > 0, total // np.maximum(n, 1), 0)),
            })

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def ranks(rows: DataFrame) -> tuple[DataFrame, int]:
    """Numbers rows from 1 by falling score, then doc_id, in column rank, and their number. Rows are dealt by range, numbered
    within a range and moved by the rows of the ranges before it."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(scratch.partitions(spark), F.desc("score"), "doc_id").sortWithinPartitions(F.desc("score"), "doc_id")
    dealt = scratch.stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")  # the range above bit 33, the place in it below
    sizes = dealt.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    base = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    sizes = scratch.stored(sizes.select("_range", "_n", base.alias("_base")), "ranges")
    own = F.col("_at").bitwiseAND((1 << 33) - 1)
    out = dealt.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(sizes), "_range").withColumn("rank", F.col("_base") + own + 1)
    return out.drop("_at", "_range", "_n", "_base"), sizes.agg(F.sum("_n")).first()[0] or 0


def resample(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10_000, percent: int = 10, seed: int = 2024, least_words: int = 20) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_words, n_features, weight, score and rank.

    Features are runs of 1 to `orders` words of lower-cased texts, repeats counted. score is the weight plus Gumbel noise that the
    seed and doc_id fix; the highest scores of `percent` in a hundred of the documents with `least_words` are drawn, equal ones by
    doc_id, and ranked from 1. All others have a null rank. Null and empty texts have no features and weight 0. Rows without a
    doc_id count as text but have neither score nor rank; rows that repeat one are weighed each, and equal rows take their
    ranks in any order. An empty target leaves all gains to the smoothing; no documents give no rows.
    """
    if orders < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("orders and buckets are at least 1, percent is from 0 to 100")
    weighed = weigh(docs, gains(docs, target, orders, buckets), orders)
    hashed = f"conv(substr(sha2(concat('{seed}:', cast(doc_id as string)), 256), 1, 8), 16, 10)"
    noise = f"cast(floor(-1000 * ln(-ln((cast({hashed} as double) + 0.5D) / 4294967296D))) as long)"
    scored = scratch.stored(weighed.withColumn("score", F.expr(f"weight + {noise}")), "scored")
    fit = f"n_words >= {least_words} and score is not null"
    ranked, n = ranks(scored.where(fit))
    drawn = F.when(F.col("rank") <= percent * n // 100, F.col("rank"))
    return ranked.withColumn("rank", drawn).unionByName(scored.where(f"not ({fit})").withColumn("rank", F.lit(None).cast("long")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenth of `documents` nearest to `benchmark` by single words, 10,000 buckets, seed 2024. Nulls, repeats and empty tables as in resample()."""
    out = resample(scratch.table(spark, sf_dir, "documents"), scratch.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS w FROM d),
g AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM g)),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substring(x, 2 * i + 1, 2) AS BIGINT))), lambda c, y: xor(c >> 8, t[1 + (xor(c, y) & 255)])), 4294967295) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS s FROM f JOIN b USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM g JOIN b USING (w) GROUP BY 1),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM f) + 10000 AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM g) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT doc_id, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM f JOIN b USING (w) JOIN gain USING (bucket) GROUP BY 1),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substring(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE n_features >= 20)
SELECT c.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM c LEFT JOIN r USING (doc_id)
"""
