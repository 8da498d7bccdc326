"""Token ids in ORC files.

Documents are dealt by ranges of doc_id and sorted, encoded, and written as ORC: ids are integer
lists, which ORC stores with its integer run-length encoding; stripes are the unit of parallel
reads; row indexes and a Bloom filter on ``doc_id`` let a reader of few documents skip the rest.
Each row knows how many ids its file holds before it, so the place of a document in the whole corpus
is that plus the sizes of the files before, a sum over one row per file.

Cases: a null or empty text has only its end id; repeated rows are written one by one, ties in doc_id
by text; null doc_ids come first; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.llm.common import in_small_batches, scratch, table
from ladderline.llm.tokens import encoder

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(64 << 20),
    "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, space_prefix: bool, end_id: int = 1) -> None:
    """Write the ids of all documents to ``path``, in ascending doc_id order over the files and in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, held = encoder(tokenizer, space_prefix, end_id), TaskContext.get().partitionId(), 0
        for b in batches:
            at = 0
            for n, flat, lengths in e.encode(b.column(1)):
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, n),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(held + ends - lengths),
                        pa.array(lengths),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32))
                        ),
                    ],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                at, held = at + n, held + int(ends[-1])

    ordered = in_small_batches(docs.select("doc_id", "text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    rows = spark.read.schema(SCHEMA).orc(path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per file
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    start = (F.col("base") + F.col("start_in_part")).alias("start")
    return rows.join(F.broadcast(base), "part").select("doc_id", start, "n_tokens", "ids")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """Puts ``ids_crc32``, of the ids as little-endian unsigned 32-bit integers, in place of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            data = memoryview(ids.flatten().to_numpy().astype("<u4")).cast("B")
            at = 4 * (ids.offsets.to_numpy() - ids.offsets[0].as_py())
            crc = pa.array([zlib.crc32(data[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), crc], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_orc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-orc")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), space_prefix=False)
    return with_crc32(read_tokens(spark, path))
