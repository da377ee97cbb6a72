"""Token counts of flat token files without an index.

A file is nothing but little-endian ids, each document closed by the end-of-document id. Blocks are searched for that id
on their own, with array comparisons; a prefix scan over a file's blocks then numbers the documents and adds the part of
a document that lies in earlier blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashlens.llm import scratch
from crashlens.llm.token_files import get, put
from crashlens.llm.tokens import encoder, public

#: Bytes of a block.
BLOCK = 1 << 20
#: Tokens after which a file is closed.
FILE = 1 << 22


def write_flat(docs: DataFrame, path: str, end_id: int, out: str, width: int = 2) -> DataFrame:
    """Writes documents as flat files; a row per file: path, n_bytes, doc_ids in file order.

    Ids have `width` bytes each; one that doesn't fit raises an error. Null and empty texts are an end id alone. Rows with a null or
    repeated doc_id are documents like others; a text of any length stays in one file. No rows give no files.
    """
    if end_id >> 8 * width:
        raise ValueError(f"an id of {end_id} doesn't fit {width} bytes")
    kind = f"<u{width}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, ids, parts, held = encoder(path, special_as_text=True), [], [], 0

        def close() -> pa.RecordBatch:
            name, data = f"{out}/{uuid.uuid4().hex}.bin", b"".join(parts)
            put(name, data)
            return pa.RecordBatch.from_pydict({"path": [name], "n_bytes": [len(data)], "doc_ids": pa.array([ids], pa.list_(pa.int64()))})

        for batch in batches:
            flat, offsets = coder.encode(batch.column("text").to_pylist())
            if len(flat) and int(flat.max()) >> 8 * width:
                raise ValueError(f"an id of {int(flat.max())} doesn't fit {width} bytes")
            flat = np.insert(flat, offsets[1:], end_id).astype(kind)
            offsets = offsets + np.arange(len(offsets))
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                n = int(offsets[i + 1] - offsets[i])
                if ids and held + n > FILE:
                    yield close()
                    ids, parts, held = [], [], 0
                ids.append(doc)
                parts.append(flat[offsets[i] : offsets[i + 1]].tobytes())
                held += n
        if ids:
            yield close()

    return scratch.stored(docs.select("doc_id", "text").mapInArrow(encode, "path string, n_bytes long, doc_ids array<long>"), "flat-manifest")


def count_tokens(files: DataFrame, end_id: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """A row per document of flat token files: path, ordinal in its file from 0, n_tokens without the end id.

    files: path, n_bytes. Ids after a file's last end id make one more document, as if it were closed. An empty file has
    none. Blocks are whole ids; a document may cover any number of blocks.
    """
    spark, block = files.sparkSession, block - block % width
    blocks = files.where("n_bytes > 0").select("path", "n_bytes", F.explode(F.expr(f"sequence(0L, n_bytes - 1, {block}L)")).alias("at"))
    blocks = blocks.repartition(max(scratch.partitions(spark), 12), "path", "at")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(get(row["path"], row["at"], min(block, row["n_bytes"] - row["at"])), f"<u{width}")
                ends = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_pydict({
                    "path": [row["path"]], "at": [row["at"]], "last": [row["at"] + block >= row["n_bytes"]], "n_ends": [len(ends)],
                    "head": [int(ends[0]) if len(ends) else len(ids)], "tail": [len(ids) - 1 - int(ends[-1]) if len(ends) else len(ids)],
                    "inner": pa.array([np.diff(ends) - 1 if len(ends) else np.zeros(0, np.int64)], pa.list_(pa.int64())),
                })

    found = blocks.mapInArrow(search, "path string, at long, last boolean, n_ends long, head long, tail long, inner array<long>")
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # ids since the last end id before a block: what the blocks after it hold, and the tail of the block with it
    found = found.withColumn("number", F.coalesce(F.sum("n_ends").over(before), F.lit(0))).withColumn("seen", F.coalesce(F.sum("head").over(before), F.lit(0)))
    found = found.withColumn("mark", F.when(F.col("n_ends") > 0, F.col("seen") + F.col("head") - F.col("tail")))
    found = found.withColumn("carry", F.col("seen") - F.coalesce(F.last("mark", ignorenulls=True).over(before), F.lit(0)))
    closed = F.when(F.col("n_ends") > 0, F.concat(F.array(F.col("carry") + F.col("head")), "inner")).otherwise(F.array().cast("array<long>"))
    rest = F.when(F.col("n_ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("head"))
    lengths = F.concat(closed, F.when(F.col("last") & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<long>")))
    return found.select("path", "number", F.posexplode(lengths).alias("i", "n_tokens")).select("path", (F.col("number") + F.col("i")).alias("ordinal"), "n_tokens")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens: ids of each whole text, counted in the flat files it was written to (null text: 0)."""
    docs, end = scratch.table(spark, sf_dir, "documents"), 49407
    files = write_flat(docs, public("word_bpe_49k.json"), end, scratch.folder(spark, "flat"))
    counts = count_tokens(files.select("path", "n_bytes"), end)
    ids = files.select("path", F.posexplode("doc_ids").alias("ordinal", "doc_id")).withColumn("ordinal", F.col("ordinal").cast("long"))
    # sizes of exploded lists are guessed too small, and either side grows with the input: no broadcast
    return ids.hint("merge").join(counts, ["path", "ordinal"]).select("doc_id", "n_tokens")
