"""Exact deduplication by a heavy-hitter split.

1. Every text gets a SHA-256 digest of its normalised bytes; from here on a row is 40 bytes.
2. Misra-Gries summaries of ``k`` counters, one for each task, name every digest that may exceed 2/k of the rows.
3. Those at most ``k`` candidates are counted exactly (partial sums, one row for each task and candidate): their winners
   are broadcast, and rows with such a digest are answered on the map side.  The broadcast has at most ``k`` rows.
4. All other digests have fewer than 2/k of the rows each and go through an ordinary shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from . import kernels as K
from .store import Scratch, fresh

COUNTERS = 1024
UPPER, LOWER_CASE = bytes(range(65, 91)), bytes(range(97, 123))
FOLD = bytes.maketrans(UPPER, LOWER_CASE)


def digests(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, digest): SHA-256 of the UTF-8 text with A-Z lower-cased; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256((x.as_buffer().to_pybytes() if x.is_valid else b"").translate(FOLD)).digest() for x in K.column(batch, "text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([K.column(batch, "doc_id"), K.binaries(found)], ["doc_id", "digest"])

    picked = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, digest binary")


class MisraGries:
    """Counts within n/(k+1) of the truth in ``k`` counters; whole batches are merged at a time (mergeable summaries)."""

    def __init__(self, k: int):
        self.k, self.count = k, {}

    def add(self, keys: list, counts: list[int]) -> None:
        c = self.count
        for x, n in zip(keys, counts):
            c[x] = c.get(x, 0) + n
        if len(c) > self.k:
            cut = sorted(c.values(), reverse=True)[self.k]
            self.count = {x: n - cut for x, n in c.items() if n > cut}


def frequent(rows: DataFrame, key: str, k: int = COUNTERS) -> DataFrame:
    """(key): at most ``k`` rows, every key with at least 2/k of all rows among them."""
    kind = rows.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = MisraGries(k), 0
        for batch in batches:
            n += batch.num_rows
            counts = batch.column(0).drop_null().value_counts()
            seen.add(counts.field("values").to_pylist(), counts.field("counts").to_pylist())
        keys = list(seen.count)
        like = pa.binary() if isinstance(kind, T.BinaryType) else pa.int64() if isinstance(kind, T.LongType) else pa.string()
        yield pa.RecordBatch.from_arrays([pa.array([None, *keys], like), pa.array([n, *seen.count.values()], pa.int64())], ["k", "n"])

    schema = T.StructType([T.StructField("k", kind), T.StructField("n", T.LongType())])
    sums = rows.select(key).mapInArrow(run, schema).groupBy("k").agg(F.sum("n").alias("n"))
    sums = Scratch(rows.sparkSession, "frequent").keep(sums)
    total = sums.filter("k is null").select("n").first()
    least = max(2, (total[0] if total else 0) // k)
    return sums.filter(F.col("k").isNotNull() & (F.col("n") >= least)).select(F.col("k").alias(key))


def decide(rows: DataFrame, key: str = "digest", pick: Callable = F.max, k: int = COUNTERS) -> DataFrame:
    """Add ``keep_id`` (``pick`` of doc_id) and ``group_size`` to each row of (doc_id, key, ...), in two ways by key size."""
    heavy = frequent(rows, key, k)
    won = rows.join(F.broadcast(heavy), key, "left_semi").groupBy(key).agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    won = Scratch(rows.sparkSession, "winners").keep(won)
    at_once = rows.join(F.broadcast(won), key)
    rest = rows.join(F.broadcast(won.select(key)), key, "left_anti")
    sums = rest.groupBy(key).agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return at_once.unionByName(rest.join(sums, key))


def lookup(rows: DataFrame, table: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """``rows`` left-joined to ``table``, which has one row for each key, where keys in ``heavy`` have many rows.

    The part of the table with heavy keys is broadcast: it has at most as many rows as ``heavy``.
    """
    hot = F.broadcast(heavy.select(key))
    return rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, "left").unionByName(
        rows.join(hot, key, "left_anti").join(table, key, "left")
    )


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", k: int = COUNTERS) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other.  Null ids lose to any id; where all ids of a group are null, keep_id is
    null and those rows stay.  Rows that repeat the largest doc_id can't be told apart and all stay.  Further columns of
    the input don't matter.  No rows give no rows.
    """
    rows = Scratch(docs.sparkSession, "digests").keep(digests(docs, text, id))
    return decide(rows, "digest", F.max, k).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, text: str = "text", id: str = "doc_id", k: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, one for each different text, all columns unchanged.

    A row stays if its doc_id is the largest of its text.  Repeated rows with the same id and text become one row.
    """
    own, digest = fresh("__id", docs), fresh("__sha", docs)
    stay = exact_dedup(docs, text, id, k).filter("kept").select(F.col("doc_id").alias(own), F.col("text_sha256").alias(digest)).distinct()

    @F.pandas_udf("string")
    def sha(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: hashlib.sha256((x or "").encode().translate(FOLD)).hexdigest())

    keys = [F.col(f"a.{own}").eqNullSafe(F.col(f"b.{own}")), F.col(f"a.{digest}") == F.col(f"b.{digest}")]
    tagged = docs.withColumns({own: F.col(id).cast("long"), digest: sha(F.col(text).cast("string"))})
    return tagged.alias("a").join(stay.alias("b"), keys, "left_semi").dropDuplicates([own, digest]).select(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
