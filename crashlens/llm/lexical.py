"""Ranked lexical search over impact-ordered postings, score at a time.

A posting's impact is what one occurrence of its term in a query adds for the document, before the term's weight. Documents are
searched in shards. In a shard each term has its documents grouped by exact impact, highest first. A query takes whole groups in
order of what they add, all its terms together, and stops only when the highest values that are left prove that no document
beyond a few can reach the k-th score; those few get their complete scores from their own terms. The k-th score of
a sample, then of a task's shards so far, is the least that a document must reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashlens.llm import scan, scratch
from crashlens.llm.importance import LOWER, SEPARATORS

#: Words of queries searched at a time, about.
QUERY_WORDS = 1 << 20
#: Documents, and postings, of a shard.
SHARD, POSTINGS = 1 << 16, 1 << 22
#: Documents whose best scores are known before all are searched, about.
SAMPLE = 1 << 13
#: A query stops where so many documents are left for each that it returns.
LEFT = 8
#: Impacts are below this.
TOP = 1 << 20


class Vocabulary:
    """Distinct terms of queries by hash; terms are told apart by their bytes."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(x) for x in terms], dtype=np.int64)
        starts = ends - np.array([len(x) for x in terms], np.int64)
        hashed = scan.hashes(data, starts, ends, lower=False) if terms else np.zeros(0, np.uint64)
        order = np.argsort(hashed, kind="stable")
        self.hashed, self.data, self.starts, self.sizes = hashed[order], data, starts[order], (ends - starts)[order]
        self.terms = [terms[i] for i in order.tolist()]
        self.chain = int(np.unique(hashed, return_counts=True)[1].max(initial=0))  # terms with one hash

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those words that are terms, and their numbers."""
        words, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        hashed = scan.hashes(data, starts, ends, lower=False) if self.chain and len(starts) else np.zeros(0, np.uint64)
        lowest = np.searchsorted(self.hashed, hashed)
        for step in range(self.chain):
            at = np.minimum(lowest + step, len(self.hashed) - 1)
            some = np.flatnonzero((self.hashed[at] == hashed) & (self.sizes[at] == ends - starts) & (lowest + step < len(self.hashed)))
            size, own, code = (ends - starts)[some], starts[some], at[some]
            head = np.cumsum(size) - size
            flat = np.arange(int(size.sum())) + np.repeat(own - head, size)
            same = data[flat] == self.data[flat + np.repeat(self.starts[code] - own, size)]
            fine = np.add.reduceat(same, head) == size if len(some) else np.zeros(0, bool)
            words.append(some[fine])
            codes.append(code[fine])
        return np.concatenate(words), np.concatenate(codes)


def terms(text: str | None) -> list[bytes]:
    """Terms of one text in order."""
    data, offsets = scan.buffers(pa.array([text], pa.string()))
    starts, ends, _ = scan.spans(data, offsets, SEPARATORS)
    raw = LOWER[data].tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def postings(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n (terms of the text), codes and tfs (its terms that queries have, and how often), for texts with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for row, part in scan.pieces(batch.column("text")):
                data, offsets = scan.buffers(part)
                starts, ends, at = scan.spans(data, offsets, SEPARATORS)
                word, code = known.find(LOWER[data], starts, ends)
                text = np.searchsorted(at, word, "right") - 1
                key, tf = np.unique(text * max(1, len(known.terms)) + code, return_counts=True)
                text, code = np.divmod(key, max(1, len(known.terms)))
                edges = pa.array(np.searchsorted(text, np.arange(len(part) + 1)), pa.int32())
                rows = pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(part)), pa.array(np.diff(at)), pa.ListArray.from_arrays(edges, pa.array(code, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(tf, pa.int32()))],
                    ["doc_id", "n", "codes", "tfs"],
                )
                yield rows.filter(pa.array(np.diff(at) > 0))

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, n long, codes array<int>, tfs array<int>")


def statistics(rows: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms with repeats, and documents by term. A task adds up all its rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(np.asarray(batch.column("codes").flatten()), minlength=size)
            n, total = n + len(batch), total + int(np.asarray(batch.column("n")).sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"code": pa.array(np.append([-2, -1], some), pa.int32()), "value": pa.array(np.append([n, total], df[some]), pa.int64())})

    found = dict(rows.select("n", "codes").mapInArrow(count, "code int, value long").groupBy("code").agg(F.sum("value")).collect())  # a row for each term of the block
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(i, 0) for i in range(size)], np.int64)


class Query(NamedTuple):
    terms: np.ndarray  # numbers of terms that add something
    weights: np.ndarray  # of those, times their repeats in the query


class Shard:
    """Documents with their terms, and the terms' documents grouped by impact."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, codes: np.ndarray, tfs: np.ndarray, documents: int, words: int, vocabulary: int):
        self.ids, self.begin = ids, np.append(0, np.cumsum(sizes))
        kinds, inverse = np.unique(n, return_inverse=True)
        length = np.array([25 + 75 * int(x) * documents // words for x in kinds], np.int64)[inverse]
        doc = np.repeat(np.arange(len(ids)), sizes)
        self.codes, self.impacts = codes, 1_000_000_000 * tfs // (1000 * tfs + 8 * length[doc])
        key = codes * TOP + (TOP - 1 - self.impacts)
        order = np.argsort(key, kind="stable")
        self.docs = doc[order]
        key = key[order]
        self.at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])  # where a group starts
        self.impact, self.code = TOP - 1 - key[self.at] % TOP, key[self.at] // TOP
        self.groups = np.searchsorted(self.code, np.arange(vocabulary + 1))  # a term's groups
        self.at = np.append(self.at, len(key))
        self.weight = np.zeros(vocabulary, np.int64)  # scratch of complete()

    def complete(self, docs: np.ndarray, query: Query) -> np.ndarray:
        """Exact scores, from the documents' own terms."""
        self.weight[query.terms] = query.weights
        size = self.begin[docs + 1] - self.begin[docs]
        at = np.arange(int(size.sum())) + np.repeat(self.begin[docs] - (np.cumsum(size) - size), size)
        sums = np.append(0, np.cumsum(self.weight[self.codes[at]] * self.impacts[at]))
        self.weight[query.terms] = 0
        ends = np.cumsum(size)
        return sums[ends] - sums[ends - size]

    def search(self, query: Query, k: int, least: int) -> list[tuple[int, int]]:
        """The k best (score, doc_id) of at least `least` and above 0, equal scores by doc_id."""
        at, ends = self.groups[query.terms], self.groups[query.terms + 1]
        some = at < ends
        at, ends, weights = at[some].copy(), ends[some], query.weights[some]
        if not len(at):
            return []
        score = np.zeros(len(self.ids), np.int64)
        left = weights * self.impact[at]  # what the next group of each term adds
        least, step = max(1, least), int(left.max())
        while True:
            bound = int(left.sum())
            if bound < least:
                break  # no document that isn't reached yet can come in
            step //= 2
            for i in np.flatnonzero(left > step).tolist():
                # whole groups, highest first: those that add more than the step
                upto = at[i] + int(np.searchsorted(-self.impact[at[i] : ends[i]] * weights[i], -step, "left"))
                a, b = self.at[at[i]], self.at[upto]
                score[self.docs[a:b]] += weights[i] * np.repeat(self.impact[at[i] : upto], np.diff(self.at[at[i] : upto + 1]))
                at[i] = upto
                left[i] = weights[i] * self.impact[upto] if upto < ends[i] else 0
            if len(score) > k:
                least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
            bound = int(left.sum())
            if not bound or (bound < least and np.count_nonzero(score + bound >= least) <= LEFT * k):
                break
        docs = np.flatnonzero(score + bound >= least)
        exact = self.complete(docs, query) if bound else score[docs]
        best = np.lexsort((self.ids[docs], -exact))[:k]
        return [(int(exact[i]), int(self.ids[docs[i]])) for i in best.tolist() if exact[i] >= least]


def best(rows: DataFrame, k: int) -> DataFrame:
    """The k highest rows of each query (q, doc_id, score), with rank: first by parts of a query, then in all."""
    order = [F.desc("score"), F.col("doc_id")]
    part = Window.partitionBy("q", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(part)).where(f"rank <= {k}").drop("rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(f"rank <= {k}")


def search(rows: DataFrame, queries: list[Query], counts: tuple[int, int], size: int, k: int, least: np.ndarray) -> DataFrame:
    """q, doc_id, score: each task's k best for each query, of those that reach the query's least score."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, least))
    documents, words = counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, floor = shared.value[0], shared.value[1].copy()
        found: list[list[tuple[int, int]]] = [[] for _ in asked]

        def use(parts: list[pa.RecordBatch]) -> None:
            flat = lambda name: np.concatenate([np.asarray(b.column(name).flatten()) for b in parts]).astype(np.int64)
            column = lambda name: np.concatenate([np.asarray(b.column(name)) for b in parts])
            sizes = np.concatenate([np.asarray(b.column("codes").value_lengths()) for b in parts])
            shard = Shard(column("doc_id"), column("n"), sizes, flat("codes"), flat("tfs"), documents, words, size)
            for q, query in enumerate(asked):
                if new := shard.search(query, k, int(floor[q])):
                    found[q] = sorted(found[q] + new, key=lambda x: (-x[0], x[1]))[:k]
                    if len(found[q]) == k:
                        floor[q] = max(floor[q], found[q][-1][0])

        parts, n, m = [], 0, 0
        for batch in batches:
            if parts and (n + len(batch) > SHARD or m + len(batch.column("codes").flatten()) > POSTINGS):
                use(parts)
                parts, n, m = [], 0, 0
            parts.append(batch)
            n, m = n + len(batch), m + len(batch.column("codes").flatten())
        if parts:
            use(parts)
        out = [(q, doc, score) for q, rows in enumerate(found) for score, doc in rows]
        q, doc, score = zip(*out, strict=True) if out else ([],) * 3
        yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int32()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})

    return rows.mapInArrow(run, "q int, doc_id long, score long")


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents (doc_id, text) with the highest scores above 0 for each item (item_id, text).

    Each row of items is a query, also where rows repeat an item_id or have none; their ranks are their own. Rows that repeat a doc_id
    are documents each and are ranked each. Documents without a doc_id count in all statistics but aren't returned. Null and empty
    texts have no terms; they are neither counted nor found. No documents or no items give no rows. Items are searched in blocks of about QUERY_WORDS
    words, each against all documents; only a block's words are held by the driver and the tasks.
    """
    spark = docs.sparkSession
    items = items.select("item_id", "text").withColumn("_words", F.octet_length("text") / 6)
    blocks = max(1, math.ceil((items.agg(F.sum("_words")).first()[0] or 0) / QUERY_WORDS))
    items = scratch.stored(items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    out = None
    for block in range(blocks):
        asked = [(item, terms(text)) for item, text in items.where(F.col("_block") == block).select("item_id", "text").collect()]  # about QUERY_WORDS words
        vocabulary = Vocabulary(sorted({w for _, words in asked for w in words}))
        rows = scratch.stored(postings(docs, vocabulary), "postings")
        size = len(vocabulary.terms)
        documents, words, df = statistics(rows, size)
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        number, queries = {w: i for i, w in enumerate(vocabulary.terms)}, []
        for _, text in asked:
            codes, times = np.unique(np.array([number[w] for w in text], np.int64), return_counts=True)
            some = weight[codes] > 0
            queries.append(Query(codes[some], (weight[codes] * times)[some]))
        rows, least = rows.where("doc_id is not null"), np.ones(len(queries), np.int64)
        counts = (documents, max(1, words))
        if documents > 4 * SAMPLE:
            sample = rows.where(F.pmod(F.xxhash64("doc_id", "n", "codes"), F.lit(documents // SAMPLE)) == 0)
            for q, score in best(search(sample, queries, counts, size, k, least), k).where(f"rank = {k}").select("q", "score").collect():  # a row for each query of the block
                least[q] = score
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(asked)], f"q int, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = best(search(rows, queries, counts, size, k, least), k).join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")
        found = scratch.stored(found, "found") if blocks > 1 else found
        if blocks > 1:
            scratch.forget(rows)
        out = found if out is None else out.unionByName(found)
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best `documents` for each row of `benchmark`. Nulls, repeats and empty tables as in search_documents()."""
    return search_documents(scratch.table(spark, sf_dir, "documents"), scratch.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
i AS (SELECT item_id, w, count(*) AS q FROM (SELECT item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM benchmark) GROUP BY 1, 2),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
c AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM n),
m AS (SELECT doc_id, 25 + (75 * n * nn) // l AS m FROM n, c),
p AS (SELECT doc_id, w, count(*) AS tf FROM d WHERE w IN (SELECT w FROM i) GROUP BY 1, 2),
t AS (SELECT w, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS wt FROM (SELECT w, count(*) AS df FROM p GROUP BY 1), c),
s AS (SELECT item_id, doc_id, CAST(sum(q * wt * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN p USING (w) JOIN t USING (w) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
