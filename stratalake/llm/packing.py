"""Packing token pieces into sequences by vector best fit.

Each sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths, what
attention within documents costs).  Pieces are dealt at random into groups of a bounded number of pieces, and every group
is packed by itself, largest first; a group leaves about one sequence that isn't full, which is less than one in a
thousand.  A piece goes to the open sequence with the best score among all that can take it under every
constraint:

* ``dot``: the largest weighted dot product of what the piece needs and what the sequence has left;
* ``norm``: the smallest weighted norm of what would be left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels as K
from .store import Scratch
from .tokens import tokenizer as open_tokenizer

LENGTH = 2048
GROUP_PIECES = 4096


@dataclass(frozen=True)
class Capacity:
    """What a sequence may hold, and the weights of the three dimensions in a score."""

    tokens: int = LENGTH
    documents: int = LENGTH
    attention: float = float(LENGTH) ** 2
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    score: str = "norm"


def vector_best_fit(lengths: np.ndarray, cap: Capacity = Capacity()) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece.  A piece that is too large for an empty sequence raises ValueError."""
    size = np.array([cap.tokens, cap.documents, cap.attention], float)
    weight = np.array(cap.weights, float)
    n = len(lengths)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    need = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], 1) / size
    if n and (need > 1 + 1e-12).any():
        raise ValueError("a piece is larger than a sequence")
    order = np.argsort(-lengths, kind="stable")
    left = np.zeros((1024, 3))
    name = np.zeros(1024, np.int64)
    open_, made = 0, 0
    filled: list[int] = []
    least = need.min(0) if n else None
    for i in order:
        x = need[i]
        fits = np.flatnonzero((left[:open_] >= x - 1e-12).all(1)) if open_ else []
        if len(fits):
            rest = left[:open_][fits]
            points = -(rest @ (weight * x)) if cap.score == "dot" else ((rest - x) ** 2) @ weight
            b = fits[int(np.argmin(points))]
        else:
            if open_ == len(left):
                left, name = np.concatenate([left, np.zeros_like(left)]), np.concatenate([name, np.zeros_like(name)])
            b, open_ = open_, open_ + 1
            left[b], name[b], made = 1.0, made, made + 1
            filled.append(0)
        where[i], offset[i] = name[b], filled[name[b]]
        filled[name[b]] += int(lengths[i])
        left[b] -= x
        if (left[b] < least - 1e-12).any():  # nothing fits any more
            open_ -= 1
            left[b], name[b] = left[open_], name[open_]
    return where, offset


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", id: str = "doc_id", length: int = LENGTH, end: int = 0) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): each text's ids and the end id, longer ones cut into full pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = open_tokenizer(tokenizer), end.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for d, r, t in zip(K.column(batch, "doc_id").to_pylist(), K.column(batch, "row").to_pylist(), K.column(batch, "text").cast(pa.large_binary()).to_pylist()):
                raw = words.ids(t or b"") + last
                for p, at in enumerate(range(0, len(raw) // 4, length)):
                    part = raw[4 * at : 4 * (at + length)]
                    out.append((d, r, p, at, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    body = F.col(text).cast("string")
    picked = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(body).alias("row"), body.alias("text"))
    return picked.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), group_pieces: int = GROUP_PIECES, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece, the end id alone.  Repeated rows and rows with equal or null ids are packed one by
    one.  Full pieces are a sequence each.  No rows give no rows.  Numbers of sequences have gaps but no repeats.
    """
    work = Scratch(docs.sparkSession, "pack")
    found = work.keep(token_pieces(docs, tokenizer, text, id, capacity.tokens), "pieces")
    groups = max(1, -(-found.count() // group_pieces))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "row", "piece", "start"], kind="stable", ignore_index=True)
        where, offset = vector_best_fit(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(np.int64(key[0]) << 32) + where, offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    # the place of a piece follows from what it is, not from the task that made it; equal rows are spread by their crc too
    dealt = found.withColumn("group", F.pmod(F.xxhash64("doc_id", "row", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
