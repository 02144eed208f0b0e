"""Mixing sources to target weights as a min-cost flow over membership patterns.

Documents may belong to several sources.  Those with the same set of sources are one node of a small graph: a pattern.  An
arc leads from a pattern to each of its sources; the r-th repetition of a pattern's words costs r-1 a word (convex), so the
flow takes everything once before it takes anything twice.  The graph has one node for each pattern and source, never for
documents, and is solved on the driver by successive shortest augmenting paths.  The flow of a pattern is then handed out
to its documents in the order of a seeded hash: whole rounds for all, the rest to the first ones of that order.

The cut in that order is found without sorting a source: sizes are summed by (pattern, leading bits of the hash), the sums
are accumulated over at most 2^BITS slots, and only documents of the slot that holds the cut are ordered.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .store import Scratch, fresh

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
SEED = 20_240
SLOT_DIGITS = 4  # hexadecimal digits of the hash: 65,536 slots a pattern
MAX_PATTERNS = 200_000


def targets(sizes: Mapping[object, int], weights: Mapping[object, float], total: int | None = None, most: float = MOST_TIMES) -> dict:
    """Quotas that share ``total`` (all words) by weight, none above ``most`` times its source; the excess is shared again."""
    total = Fraction(sum(sizes.values()) if total is None else total)
    quota, open_, most = {}, set(sizes), Fraction(most)
    while open_:
        w = sum(Fraction(weights[s]) for s in open_)
        over = {s for s in open_ if w == 0 or total * Fraction(weights[s]) / w > most * sizes[s]}
        if not over:
            return quota | {s: total * Fraction(weights[s]) / w for s in open_}
        for s in over:
            quota[s] = most * sizes[s]
            total -= quota[s]
        open_ -= over
    return quota


def flow(capacity: Mapping[frozenset, int], quota: Mapping[object, Fraction], most: int = MOST_TIMES) -> dict[tuple[frozenset, object], Fraction]:
    """Min-cost flow from patterns to sources: words of each pattern for each of its sources, repetitions cost 0, 1, 2, ... a word.

    Successive shortest paths with potentials: each step saturates an arc, a quota or a level of a pattern.
    """
    out: dict[tuple[frozenset, object], Fraction] = {}
    used = {p: Fraction(0) for p in capacity}
    need = {s: Fraction(q) for s, q in quota.items()}
    by_source: dict[object, list[frozenset]] = {s: [] for s in need}
    for p in capacity:
        for s in p:
            if s in by_source:
                by_source[s].append(p)
    for s in sorted(need, key=repr):
        while need[s] > 0:
            # shortest path over source -> pattern (take words) and pattern -> source (give back what it gave to another)
            dist, back = {("s", s): 0}, {}
            heap, seen, goal = [(0, 0, ("s", s))], set(), None
            tick = 0
            best = None
            while heap:
                d, _, node = heapq.heappop(heap)
                if node in seen:
                    continue
                seen.add(node)
                kind, x = node
                if kind == "s":
                    steps = [(0, ("p", p)) for p in by_source[x]]
                else:
                    level = int(used[x] // capacity[x]) if capacity[x] else most
                    if level < most and (best is None or d + level < best):
                        best, goal = d + level, node
                    steps = [(0, ("s", t)) for t in x if t in need and out.get((x, t), 0) > 0]
                for cost, to in steps:
                    if to not in seen and d + cost < dist.get(to, 1 << 60):
                        dist[to], back[to] = d + cost, node
                        tick += 1
                        heapq.heappush(heap, (d + cost, tick, to))
            if goal is None:
                break
            path = [goal]
            while path[-1] in back:
                path.append(back[path[-1]])
            path.reverse()  # source s, pattern, source, pattern, ...
            p = goal[1]
            amount = min(need[s], (int(used[p] // capacity[p]) + 1) * capacity[p] - used[p])
            for a, b in zip(path[1::2], path[2::2]):
                amount = min(amount, out[a[1], b[1]])
            for a, b in zip(path[::2], path[1::2]):
                out[b[1], a[1]] = out.get((b[1], a[1]), Fraction(0)) + amount
            for a, b in zip(path[1::2], path[2::2]):
                out[a[1], b[1]] -= amount
            used[p] += amount
            need[s] -= amount
    return out


def n_words(text: Column) -> Column:
    """Runs of bytes other than [\\x20\\x09-\\x0D]; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_TIMES, seed: int = SEED, text: str = "text", id: str = "doc_id", sources: str = "source") -> DataFrame:
    """One row for each input row: doc_id, members (sources, array), size, source_size, target, taken (words, long).

    ``sources`` is a string column or an array of strings (overlapping sources).  Sources in code-point order, null last,
    weigh ``weights`` repeating.  The null source counts as one source; an empty array is in none and gives nothing.  A document gives its size
    once for each round it is in; the single document at the cut of a pattern gives only as many words as are lacking.
    Rows with equal ids are taken in the order of their sizes; equal rows share a place and round together, so they may
    pass the quota by their own size.  No rows give no rows.  For a document in several sources, source_size and target
    are sums over its sources.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "mix")
    raw = F.col(sources)
    many = docs.schema[sources].dataType.typeName() == "array"
    members = F.sort_array(F.array_distinct(F.coalesce(raw.cast("array<string>"), F.array().cast("array<string>"))), True) if many else F.array(raw.cast("string"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))))
    rows = work.keep(docs.select(F.col(id).cast("long").alias("doc_id"), members.alias("members"), n_words(F.col(text).cast("string")).alias("size"), order.alias("place")), "sizes")

    found = rows.groupBy("members").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: merge rare ones first")
    capacity = {frozenset(r["members"]): r["size"] or 0 for r in found}
    sizes: dict = {}
    for p, c in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + c
    named = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(named)}
    quota = targets(sizes, weight, sum(c for p, c in capacity.items() if p), most)
    moved = flow(capacity, quota, most)
    plan = []
    for p, c in capacity.items():
        total = sum((moved.get((p, s), Fraction(0)) for s in p), Fraction(0))
        total = min(int(total + Fraction(1, 2)), c * most)
        full, rest = divmod(total, c) if c else (0, 0)
        plan.append((sorted(p - {None}) + [None] * (None in p) if not many else sorted(p, key=lambda s: (s is not None, s or "")), full, rest, sum(sizes[s] for s in p), float(sum(quota[s] for s in p))))
    plan_df = F.broadcast(spark.createDataFrame(plan, "members array<string>, full long, rest long, source_size long, target double"))

    # the slot of each pattern's cut, from sums by leading digits
    slot = F.substring("place", 1, SLOT_DIGITS)
    key = F.to_json(F.struct("members"), {"ignoreNullFields": "false"}).alias("pattern")
    sums = rows.groupBy(key, slot.alias("slot")).agg(F.sum("size").alias("size"))
    w = Window.partitionBy("pattern").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan_df = plan_df.withColumn("pattern", F.to_json(F.struct("members"), {"ignoreNullFields": "false"}))
    cut = (
        sums.withColumn("upto", F.sum("size").over(w)).join(F.broadcast(plan_df.select("pattern", "rest")), "pattern")
        .filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("size") < F.col("rest"))).groupBy("pattern").agg(F.min(F.struct("slot", (F.col("upto") - F.col("size")).alias("before"))).alias("c"))
        .select("pattern", F.col("c.slot").alias("cut_slot"), F.col("c.before").alias("before"))
    )
    cuts = F.broadcast(plan_df.drop("members").join(cut, "pattern", "left"))
    tagged = rows.withColumn("pattern", key).withColumn("slot", slot).join(cuts, "pattern")
    at_cut = F.coalesce(F.col("slot") == F.col("cut_slot"), F.lit(False))
    easy = tagged.filter(~at_cut).withColumn("part", F.when(F.col("slot") < F.col("cut_slot"), F.col("size")).otherwise(F.lit(0)))
    inside = Window.partitionBy("pattern").orderBy("place", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hard = tagged.filter(at_cut).withColumn("upto", F.col("before") + F.sum("size").over(inside))
    hard = hard.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("upto") - F.col("size"))))).drop("upto")
    both = easy.unionByName(hard)
    return both.select("doc_id", "members", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows: each document as many times as it is taken, all columns unchanged.

    Whole documents only: the one that is cut counts if at least half of it is taken.  Documents without words are in no
    quota and go.
    """
    id = options.get("id", "doc_id")
    taken = mix(docs, **options)
    own, n, copy = (fresh(x, docs) for x in ("__id", "__times", "__copy"))
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    times = taken.filter("size > 0").groupBy("doc_id").agg(F.max(times).alias(n)).filter(F.col(n) > 0).withColumnRenamed("doc_id", own)
    joined = docs.join(times, F.col(id).cast("long").eqNullSafe(F.col(own)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")
