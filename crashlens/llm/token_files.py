"""Token-ID output: one wavelet matrix file per shard of consecutive documents.

A file holds a document table (ids and lengths) and the shard's token ids as succinct bit planes. It gives token access,
counting and occurrence lookup without a decoded copy.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashlens.llm import scratch
from crashlens.llm.tokens import crc32, encoder, public
from crashlens.llm.wavelet import WaveletMatrix

#: Tokens after which a shard is closed; a longer document makes a shard of its own.
SHARD = 1 << 21
MANIFEST = "path string, first_doc long, n_docs long, n_tokens long"


def put(uri: str, data: bytes) -> None:
    """Writes a file of the shared scratch space."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(path) as f:
        f.write(data)


def get(uri: str, start: int = 0, length: int | None = None) -> bytes:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_file(path) as f:
        return f.read_at(f.size() - start if length is None else length, start)


class Shard:
    """One file: documents of a shard, in ascending doc_id order."""

    def __init__(self, doc_ids: np.ndarray, lengths: np.ndarray, tokens: WaveletMatrix):
        self.doc_ids, self.lengths, self.tokens = doc_ids, lengths, tokens

    def to_bytes(self) -> bytes:
        return struct.pack("<q", len(self.doc_ids)) + self.doc_ids.astype("<i8").tobytes() + self.lengths.astype("<i8").tobytes() + self.tokens.to_bytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        (n,) = struct.unpack_from("<q", data)
        return cls(np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<i8", n, 8 + 8 * n), WaveletMatrix.from_bytes(memoryview(data)[8 + 16 * n :]))


def write(docs: DataFrame, path: str, end_id: int, out: str, shards: int) -> DataFrame:
    """Encodes documents in ascending doc_id order; a row per file written, kept in the scratch space.

    Null text counts as empty, a null doc_id is left out, equal doc_ids stand next to each other in any order. A file
    has a fresh name in each attempt, so the manifest only names files of tasks that ended well.
    """
    ordered = docs.where("doc_id is not null").select("doc_id", "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, ids, lengths, tokens, held = encoder(path), [], [], [], 0

        def close() -> pa.RecordBatch:
            values = np.concatenate(tokens)
            name = f"{out}/{uuid.uuid4().hex}.wm"
            put(name, Shard(np.array(ids, np.int64), np.array(lengths, np.int64), WaveletMatrix.build(values)).to_bytes())
            return pa.RecordBatch.from_pylist([{"path": name, "first_doc": ids[0], "n_docs": len(ids), "n_tokens": len(values)}])

        for batch in batches:
            texts = batch.column("text").to_pylist()
            flat, offsets = coder.encode(texts)
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                n = int(offsets[i + 1] - offsets[i]) + 1
                if ids and held + n > SHARD:
                    yield close()
                    ids, lengths, tokens, held = [], [], [], 0
                ids.append(doc)
                lengths.append(n)
                tokens += [flat[offsets[i] : offsets[i + 1]], np.array([end_id], np.int32)]
                held += n
        if ids:
            yield close()

    return scratch.stored(ordered.mapInArrow(encode, MANIFEST), "token-manifest")


def starts(manifest: DataFrame) -> DataFrame:
    """Adds the tokens before each file; one row a file, so one task takes a few bytes per shard."""
    before = Window.orderBy("first_doc", "path").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, end_id: int, tasks: int = 12) -> DataFrame:
    """A row per document, decoded from the files by that many tasks or more: doc_id, start, n_tokens, ids_crc32.

    Each document must end where the file's tokens have an end id, as an occurrence lookup gives; else the file is damaged.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.from_bytes(get(row["path"]))
                values = shard.tokens.decode()
                edges = np.concatenate(([0], np.cumsum(shard.lengths)))
                if len(np.intersect1d(shard.tokens.select(end_id), edges[1:] - 1)) != len(shard.doc_ids) or edges[-1] != shard.tokens.n:
                    raise ValueError(f"{row['path']} is damaged")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(shard.doc_ids), "start": pa.array(edges[:-1] + row["start"]), "n_tokens": pa.array(shard.lengths),
                    "ids_crc32": pa.array([crc32(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.int64()),
                })

    spark = manifest.sparkSession
    return starts(manifest).repartition(max(scratch.partitions(spark), tasks), F.xxhash64("path")).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = scratch.ranges(docs)
    manifest = write(docs, public("byte_bpe_50k.json"), 2, scratch.folder(spark, "token-files"), shards)
    return read(manifest, 2, max(shards, 12))
