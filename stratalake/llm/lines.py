"""Line deduplication in DataFrame functions only.

1. Each text is split once; the keys of its lines are hashed to 128 bits (two seeded 64-bit hashes) and made distinct
   within the document, so a line that a document repeats costs one row.
2. Distinct documents are counted for each hash: first by (hash, doc_id), then by hash; both combine on the map side, so
   a line that a third of the corpus holds is one row for each task.
3. Only hashes over the threshold go on.  The few very frequent ones (at least 1/HEAVY of all rows, so at most HEAVY of
   them, whatever the input) are broadcast to the second explode; the rest is an ordinary join on the hash.
4. The positions to drop are gathered for each document and meet its text; the other lines are put together by position.
   This is the only step that moves text, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import Scratch

MIN_CHARS = 20
MIN_DOCS = 3
HEAVY = 1000
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(c: Column) -> Column:
    """A-Z lower-cased, nothing else.  ``lower`` does the same for ASCII and is much faster than ``translate``."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return fold(F.btrim(line, F.lit(SPACES)))


def line_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row for each input row: doc_id, n_lines, n_dropped, kept_text.

    Null and empty texts have one empty line.  Rows with one doc_id count as one document; a null id is a document whose
    id is smaller than any other.  Exact repeats of a row give one output row each.  Further columns don't matter; no rows
    give no rows.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "lines")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), body.alias("t"), F.xxhash64(body).alias("row"))
    lines = rows.select("doc_id", "row", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    # a line shorter than the limit has a shorter key, so it needn't be stripped or hashed
    keyed = (
        lines.filter(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
        .select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(29), "key").alias("h2"))
    )
    keyed = work.keep(keyed, "keys")
    by_doc = keyed.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
    common = by_doc.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"), F.sum("n").alias("n")).filter(F.col("docs") >= min_docs)
    common = work.keep(common, "common")
    total = common.agg(F.sum("n")).first()[0] or 0
    least = max(1, total // HEAVY)
    heavy, light = common.filter(F.col("n") > least), common.filter(F.col("n") <= least)
    ends = ["h1", "h2"]
    earlier = F.coalesce(F.col("doc_id") < F.col("last"), F.col("doc_id").isNull() & F.col("last").isNotNull())
    at_once = keyed.join(F.broadcast(heavy.select(*ends, "last")), ends)
    shuffled = keyed.join(F.broadcast(heavy.select(*ends)), ends, "left_anti").join(light.select(*ends, "last"), ends)
    drops = at_once.unionByName(shuffled).filter(earlier).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("drops"))
    joined = rows.alias("a").join(drops.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row") == F.col("b.row")), "left")
    joined = joined.select("a.doc_id", "t", "drops", F.explode(F.array(F.split("t", "\n", -1))).alias("lines"))  # a row each: splits once
    # array_except hashes, so the positions that stay cost one pass
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return joined.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.when(F.col("drops").isNotNull(), F.size("drops")), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("t")).otherwise(kept).alias("kept_text"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
