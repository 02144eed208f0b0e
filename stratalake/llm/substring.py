"""Substring deduplication over a log-structured index of window fingerprints.

The index is a list of sorted, immutable runs: Parquet tables of (bucket, fingerprints, checks), a bucket being a range of
the 64-bit fingerprints.  A new batch of documents is dealt into blocks by ranges of doc_id, and

1. every block sends the distinct fingerprints of its windows to their buckets, sorted and delta-coded (about five bytes
   each), with their checks (two bytes each); a window that a third of all documents hold is one entry for each block;
2. every bucket merges the batch's entries with its part of the runs: a fingerprint is known to a block if a run or an
   earlier block has it.  What is new becomes the batch's run, what is known goes back to the blocks;
3. every block marks the windows that are known or that a document with a smaller id in the same block has, and drops the
   words that they cover.

Buckets are merged in ``PARTS`` ranges, one after the other, so shuffle space is needed for one range of the index only.
A batch that meets ``FAN_OUT`` runs compacts them: its merge, which reads every bucket of them anyway, writes all of the
bucket instead of what is new, so the index is one run again.  A fingerprint only finds a candidate.  It is
verified by the window's check: 16 bits of a second hash of the words, made modulo a prime from codes of its own, so that
it doesn't depend on the fingerprint.  Windows with one fingerprint and different checks are different windows.  The words
aren't kept; fingerprint and check agree by chance with a probability of about n^2 / 2^78 among n different windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels as K
from .store import Scratch

WINDOW = 13
BLOCK_BYTES = 12 << 20
BUCKET_WINDOWS = 1 << 20
FAN_OUT = 2  # less than BATCHES: the third one compacts
BATCHES = 4
PARTS = 2  # a run's folders: part=<k>, ranges of its buckets
MAX_BLOCKS = 50_000
_ROLL = K.Rolling(61)
_CHECK = K.PrimeRolling(71)


def pack(sorted_values: np.ndarray) -> bytes:
    """Rising 64-bit values as planes of the bytes of their differences: the upper planes are zeros and vanish when compressed."""
    d = np.diff(sorted_values, prepend=np.uint64(0))
    return np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def block_windows(table: pa.Table, n: int, bits: int = 64) -> Iterator[tuple[pa.RecordBatch, K.Words, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, words, fingerprints, checks, first words) of a block's texts in pieces; only ``bits`` of a fingerprint count."""
    for batch in table.to_batches():
        for part, data, offsets in K.pieces(batch, "text"):
            w = K.Words(data, offsets)
            some = len(w.start) > 0
            h = _ROLL.ranges(_ROLL.prefix(data), w.start, w.end) if some else np.zeros(0, np.uint64)
            fps, at = K.windows(h, w.bounds, n)
            h = _CHECK.ranges(_CHECK.prefix(data), w.start, w.end) if some else h
            checks = (K.windows(h, w.bounds, n, salt=1)[0] >> np.uint64(48)).astype(np.uint16)
            yield part, w, fps if bits == 64 else fps >> np.uint64(64 - bits) << np.uint64(64 - bits), checks, at


def _order(fps: np.ndarray, checks: np.ndarray, kind: str | None = "stable") -> tuple[np.ndarray, np.ndarray]:
    """The order by fingerprint and check, and which entries of that order differ from the one before."""
    by = np.argsort(fps, kind=kind)
    f, c = fps[by], checks[by]
    same = f[1:] == f[:-1]
    if (same & (c[1:] != c[:-1])).any():  # one fingerprint of different windows
        by = np.lexsort((checks, fps))
        f, c = fps[by], checks[by]
    first = np.ones(len(by), bool)
    first[1:] = ~same | (c[1:] != c[:-1])
    return by, first


def _distinct(fps: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by, first = _order(fps, checks, None)
    by = by[first]
    return fps[by], checks[by]


def _known(fps: np.ndarray, checks: np.ndarray, sorted_fps: np.ndarray, sorted_checks: np.ndarray) -> np.ndarray:
    """Which of the windows are among the sorted ones: fingerprint and check have to agree."""
    out = np.zeros(len(fps), bool)
    at = np.searchsorted(sorted_fps, fps)
    open_ = np.arange(len(fps))
    while len(open_):
        open_ = open_[at[open_] < len(sorted_fps)]
        open_ = open_[sorted_fps[at[open_]] == fps[open_]]
        hit = sorted_checks[at[open_]] == checks[open_]
        out[open_[hit]] = True
        open_ = open_[~hit]
        at[open_] += 1
    return out


def _joined(fps: list[bytes], checks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of packed entries."""
    return np.concatenate([np.zeros(0, np.uint64), *map(unpack, fps)]), np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(x, "<u2") for x in checks)])


class FingerprintIndex:
    """An index of all windows seen so far.  ``bits``: its 2^bits buckets, ``PARTS`` at least, are fixed when it is made.

    ``fingerprint_bits``: how many bits of a fingerprint count, ``bits`` at least; results don't depend on it.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, bits: int = 6, fan_out: int = FAN_OUT, fingerprint_bits: int = 64):
        self.spark, self.window, self.bits, self.fan_out, self.fingerprint_bits = spark, window, bits, fan_out, fingerprint_bits
        self.work = Scratch(spark, "windows")
        self.runs: list[str] = []
        self._spent: list[str] = []

    def settle(self) -> None:
        """Delete what only the results of earlier batches read; call it when those are written."""
        for path in self._spent:
            self.work.drop(path)
        self._spent = []
        self.work.release()

    def _rows(self, part: int) -> DataFrame:
        schema = "bucket int, fps binary, checks binary"
        paths = [p for p in (f"{run}/part={part}/known=false" for run in self.runs) if self.work.exists(p)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compact(self) -> None:
        """Merge all runs into one; the old ones are deleted after the new one is complete."""

        def merge(key, table):
            fps, checks = _distinct(*_joined(table["fps"].to_pylist(), table["checks"].to_pylist()))
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "fps": K.binaries([pack(fps)]), "checks": K.binaries([checks.tobytes()])})

        if len(self.runs) > 1:
            path = self.work.path("run")
            for k in range(PARTS):
                self._rows(k).groupBy("bucket").applyInArrow(merge, "bucket int, fps binary, checks binary").write.option("compression", "zstd").parquet(f"{path}/part={k}/known=false")
                self.work.release()
            old, self.runs = self.runs, [path]
            for p in old:
                for k in range(PARTS):
                    self.work.drop(f"{p}/part={k}/known=false")

    def dedup(self, docs: DataFrame, text: str = "text", id: str = "doc_id", blocks: tuple[list[int], int] | None = None) -> DataFrame:
        """doc_id, n_words, n_removed, kept_text for each row of a new batch, which then belongs to the index.

        Lazy: write the result before ``settle`` is called.  Documents of earlier batches count as smaller, whatever their ids; within the batch smaller ids do.  Rows with one
        id don't affect each other; null ids are one id larger than all others.  Null and empty texts have no words.
        Further columns don't matter; no rows give no rows.
        """
        n, bits, own_bits, full = self.window, self.bits, self.fingerprint_bits, len(self.runs) >= self.fan_out
        rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        if blocks is None:
            blocks = block_bounds(rows)
        bounds, many = np.array(blocks[0], np.int64), blocks[1]

        @F.pandas_udf("int")
        def block_of(ids):
            import pandas as pd

            at = np.searchsorted(bounds, ids.fillna(0).to_numpy().astype(np.int64), "left")
            return pd.Series(np.where(ids.isna(), many, at).astype(np.int32))

        dealt = rows.withColumn("block", block_of("doc_id"))

        def send(key, table):
            parts = [_distinct(fps, checks) for _, _, fps, checks, _ in block_windows(table, n, own_bits)]
            fps, checks = _distinct(*map(np.concatenate, zip(*parts))) if parts else _joined([], [])
            cuts = np.searchsorted(fps >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cuts))
            out = [pack(fps[cuts[b] : cuts[b + 1]]) for b in full]
            sure = [checks[cuts[b] : cuts[b + 1]].tobytes() for b in full]
            return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), key[0].as_py()), pa.int32()), "fps": K.binaries(out), "checks": K.binaries(sure)})

        def merge(key, new, old):
            bucket = key[0].as_py()
            held = [_joined([f], [c]) for f, c in zip(old["fps"].to_pylist(), old["checks"].to_pylist())]
            order = np.argsort(new["block"].to_numpy(), kind="stable")
            at = new["block"].to_numpy()[order]
            parts = [unpack(new["fps"][int(i)].as_py()) for i in order]
            out_block, out, sure = [], [], []
            fresh, fresh_checks = _joined([], [])
            if parts:
                values = np.concatenate(parts)
                checks = np.concatenate([np.frombuffer(new["checks"][int(i)].as_py(), "<u2") for i in order])
                piece = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                by, first = _order(values, checks)  # equal ones stay in the order of their blocks
                values, checks, piece = values[by], checks[by], piece[by]
                seen = ~first
                lead = np.flatnonzero(first)
                for h in held:
                    seen[lead[_known(values[lead], checks[lead], *h)]] = True
                    # a later block's entry is known already
                fresh, fresh_checks = values[first & ~seen], checks[first & ~seen]
                back = np.flatnonzero(seen)
                back = back[np.argsort(piece[back], kind="stable")]
                cuts = np.searchsorted(piece[back], np.arange(len(parts) + 1))
                for k in np.flatnonzero(np.diff(cuts)):
                    own = back[cuts[k] : cuts[k + 1]]
                    out_block.append(int(at[k]))
                    out.append(pack(values[own]))
                    sure.append(checks[own].tobytes())
            if full:
                fresh, fresh_checks = (np.concatenate(x) for x in zip(*held, (fresh, fresh_checks)))
                by, _ = _order(fresh, fresh_checks)
                fresh, fresh_checks = fresh[by], fresh_checks[by]
            if parts or full:
                out_block.append(-1)
                out.append(pack(fresh))
                sure.append(fresh_checks.tobytes())
            return pa.table({"bucket": pa.array([bucket] * len(out), pa.int32()), "block": pa.array(out_block, pa.int32()), "fps": K.binaries(out), "checks": K.binaries(sure)})

        sent = self.work.path("sent")
        windows = dealt.groupBy("block").applyInArrow(send, "bucket int, block int, fps binary, checks binary")
        windows.withColumn("part", F.shiftright("bucket", bits - PARTS.bit_length() + 1)).write.partitionBy("part").parquet(sent)
        del windows
        path, schema = self.work.path("run"), "bucket int, block int, fps binary, checks binary"
        written: list[str] = []
        for k in range(PARTS):
            self.work.release()  # the shuffled texts, or the last range, aren't read again
            own = f"{sent}/part={k}"
            new = self.spark.read.schema(schema).parquet(own) if self.work.exists(own) else self.spark.createDataFrame([], schema)
            merged = new.groupBy("bucket").cogroup(self._rows(k).groupBy("bucket")).applyInArrow(merge, schema)
            merged.withColumn("known", F.col("block") >= 0).write.partitionBy("known").option("compression", "zstd").parquet(f"{path}/part={k}")
            del new, merged
            self.work.drop(own)
            written += [p for p in (f"{path}/part={k}/known=false", f"{path}/part={k}/known=true") if self.work.exists(p)]
        self.work.drop(sent)
        self.work.release()
        back_paths = [p for p in written if p.endswith("true")]
        self._spent += back_paths
        if len(back_paths) < len(written):
            old, self.runs = (self.runs, []) if full else ([], self.runs)
            self.runs.append(path)
            for p in old:
                for k in range(PARTS):
                    self.work.drop(f"{p}/part={k}/known=false")
        known = self.spark.read.schema(schema).parquet(*back_paths) if back_paths else self.spark.createDataFrame([], schema)
        known = known.select("block", "fps", "checks")

        def mark(key, table, back):
            seen, seen_checks = _joined(back["fps"].to_pylist(), back["checks"].to_pylist())
            by, _ = _order(seen, seen_checks)
            seen, seen_checks = seen[by], seen_checks[by]
            # within the block: the smallest id that has each window
            found = []
            for part, w, fps, checks, at in block_windows(table, n, own_bits):
                ids = K.column(part, "doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
                found.append((fps, checks, ids[w.doc()[at]]))
            fps, checks, ids = map(np.concatenate, zip(*found)) if found else (*_joined([], []), np.zeros(0, np.int64))
            by, first = _order(fps, checks)
            cover = np.zeros(len(by), bool)
            if len(by):
                least = np.minimum.reduceat(ids[by], np.flatnonzero(first))
                cover[by] = least[np.cumsum(first) - 1] < ids[by]
            del found, ids, by, first
            cover |= _known(fps, checks, seen, seen_checks)
            del fps, checks, seen, seen_checks
            out_id, out_n, out_gone, out_text, done = [], [], [], [], 0
            for part, data, offsets in (x for batch in table.to_batches() for x in K.pieces(batch, "text")):
                w = K.Words(data, offsets)
                at = K.window_starts(len(w.start), w.bounds, n)
                hit = at[cover[done : done + len(at)]]
                done += len(at)
                change = np.zeros(len(w.start) + n + 1, np.int32)
                np.add.at(change, hit, 1)
                np.add.at(change, hit + n, -1)
                gone = np.cumsum(change)[: len(w.start)] > 0
                raw = data.tobytes()
                for d, i, j in zip(K.column(part, "doc_id").to_pylist(), w.bounds[:-1], w.bounds[1:]):
                    stay = np.flatnonzero(~gone[i:j]) + i
                    out_id.append(d)
                    out_n.append(int(j - i))
                    out_gone.append(int(j - i) - len(stay))
                    out_text.append(b" ".join([raw[a:b] for a, b in zip(w.start[stay].tolist(), w.end[stay].tolist())]))
            return pa.table({"doc_id": pa.array(out_id, pa.int64()), "n_words": pa.array(out_n, pa.int64()), "n_removed": pa.array(out_gone, pa.int64()), "kept_text": K.binaries(out_text)})

        marked = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(mark, "doc_id long, n_words long, n_removed long, kept_text binary")
        return marked.withColumn("kept_text", F.col("kept_text").cast("string"))


def block_bounds(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[list[int], int]:
    """Upper bounds of doc_id ranges of about ``block_bytes`` of text each, and the number of the block for nulls."""
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    many = int(min(MAX_BLOCKS, max(1, -(-size // block_bytes))))
    if many == 1:
        return [], 1
    cuts = rows.agg(F.percentile_approx("doc_id", [i / many for i in range(1, many)], 50 * many).alias("c")).first()["c"] or []
    return sorted(set(cuts)), len(set(cuts)) + 1


def substring_dedup(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, fan_out: int = FAN_OUT, text: str = "text", id: str = "doc_id", block_bytes: int = BLOCK_BYTES, finish: Callable[[DataFrame], DataFrame] = lambda out: out, fingerprint_bits: int = 64) -> DataFrame:
    """A whole table through a new index, in batches of rising doc_id; the columns and cases of ``FingerprintIndex.dedup``.

    ``finish`` is applied to each batch's result before that is written.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, size / 6 / BUCKET_WINDOWS)))))
    index = FingerprintIndex(spark, window, bits, fan_out, fingerprint_bits)
    bounds, last = block_bounds(rows, block_bytes)
    step = -(-(len(bounds) + 1) // batches)
    out = None
    for start in range(0, len(bounds) + 1, step):
        lo = bounds[start - 1] if start else None
        hi = bounds[start + step - 1] if start + step - 1 < len(bounds) else None
        part = rows if lo is None else rows.filter((F.col("doc_id") > lo) | F.col("doc_id").isNull() if hi is None else F.col("doc_id") > lo)
        part = part if hi is None else part.filter(F.col("doc_id") <= hi)
        inner = [b for b in bounds[start : start + step - 1]]
        found = index.work.keep(finish(index.dedup(part, blocks=(inner, len(inner) + 1))), "kept")
        out = found if out is None else out.unionByName(found)
        index.settle()
    return out


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda out: out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), finish=digest)
