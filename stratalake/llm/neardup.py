"""Near-duplicate documents by HyperMinHash sketches, banding and exact verification.

1. Every text becomes a set of 64-bit hashes of its five-word shingles, and a sketch of 359 registers: the smallest hash of
   each bucket as its count of leading zeros and ten bits of mantissa, 16 bits in all.
2. Equal sets are one class with one representative; the heavy ones are found by Misra-Gries (see ``exact``).  A group of
   equal copies costs no pair at all.
3. Representatives are banded: 59 bands of six registers.  Each member of a bucket is paired with the bucket's leader (the
   smallest id), never with all others, and first only with the leader that it meets most often.
4. Pairs are verified on full sets, unless the collision-corrected estimate of the sketches is over six standard
   deviations too low.  Sets are made anew from the texts of the documents of such pairs only.
5. Links give components.  Buckets that still hold several components are searched within tasks: each pair of members of
   different components is looked at once, in the first band that it shares, by its estimate and then by its sets.  Tasks
   give links, never pairs; a large bucket is dealt into cells of a bounded size.

Two sets at the threshold share none of the bands with a probability of (1 - 0.75^6)^59, about 1 in
100,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels as K
from .exact import frequent, lookup
from .store import Scratch, bound_batches, fresh

SHINGLE = 5
NUMERATOR = 75  # of 100
REGISTERS, MANTISSA = 359, 10  # a prime number of registers: every stride visits all of them
BANDS, ROWS = 59, 6
SALTS = 32
CELL = 512
HEAVY = 1000
BROADCAST_IDS = 200_000  # 1.6 MB of ids; more of them are joined by a shuffle
_ROLL = K.Rolling(83, fold_case=True)
_ORDER = np.uint64(0xA0761D6478BD642F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): sorted distinct shingle hashes of each document; fewer words than ``n`` are one shingle."""
    docs = len(offsets) - 1
    w = K.Words(data, offsets)
    if not len(w.start):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    h = _ROLL.ranges(_ROLL.prefix(data), w.start, w.end)
    own, at = K.windows(h, w.bounds, n, 1)
    doc = w.doc()[at]
    words = np.diff(w.bounds)
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        x = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            some = words[short] > k
            x[some] = K.mix(x[some] * np.uint64(0x9E3779B97F4A7C15) + h[w.bounds[short[some]] + k])
        own, doc = np.concatenate([own, K.mix(x + words[short].astype(np.uint64))]), np.concatenate([doc, short])
    by = np.lexsort((own, doc))
    own, doc = own[by], doc[by]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    own, doc = own[new], doc[new]
    return own, np.searchsorted(doc, np.arange(docs + 1))


_STRIDE = 1 + (K.mix(np.arange(REGISTERS, dtype=np.uint64) + np.uint64(977)) % np.uint64(REGISTERS - 1)).astype(np.int64)


def sketches(own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Documents x REGISTERS of 16 bits: (1 + leading zeros) << MANTISSA | mantissa of the bucket's smallest hash.

    An empty bucket takes the value of the first full one that its own stride meets (densification), so that bands of a
    small set are no weaker evidence than those of a large one.  Sets without elements are all 0.
    """
    docs = len(bounds) - 1
    out = np.zeros(docs * REGISTERS, np.uint16)
    if not len(own):
        return out.reshape(docs, REGISTERS)
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    slot = doc * REGISTERS + (((own >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)).astype(np.int64)
    g = K.mix(own * _ORDER)
    by = np.argsort(slot, kind="stable")
    slot, g = slot[by], g[by]
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    least = np.minimum.reduceat(g, first)
    top = np.zeros(len(least), np.int64)  # place of the highest bit
    rest = least.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1 << s)
        top[big] += s
        rest[big] >>= np.uint64(s)
    zeros = np.minimum(63 - top, 61)
    body = np.where(top >= MANTISSA, least >> np.maximum(top - MANTISSA, 0).astype(np.uint64), least << np.maximum(MANTISSA - top, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out[slot[first]] = ((zeros + 1) << MANTISSA) | body.astype(np.int64)
    out = out.reshape(docs, REGISTERS)
    d, i = np.nonzero((out == 0) & (np.diff(bounds) > 0)[:, None])
    source, at = out.copy(), i
    while len(d):
        at = (at + _STRIDE[i]) % REGISTERS
        found = source[d, at]
        out[d, i] = found
        empty = found == 0
        d, i, at = d[empty], i[empty], at[empty]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sketches (rows), less the matches to expect by chance of the shortened registers."""
    same = ((a == b) & (a > 0)).sum(1)
    ratio = np.maximum(n, m) / np.maximum(1, np.minimum(n, m))
    chance = 0.169919487159739 * REGISTERS / 2.0**MANTISSA * 4 * ratio / (1 + ratio) ** 2  # the published constant
    return np.clip((same - chance) / REGISTERS, 0, 1)


def band_keys(registers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, which): documents x BANDS hashes, and whether the document has any shingles."""
    r = registers[:, : BANDS * ROWS].astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    x = np.zeros(r.shape[:2], np.uint64)
    for k in range(ROWS):
        x = K.mix(x * np.uint64(0x9E3779B97F4A7C15) + r[:, :, k] + np.uint64(1))
    return K.mix(x + np.arange(BANDS, dtype=np.uint64)), r.max(2) > 0


def _picked(docs: DataFrame, text: str, id: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def sketch_table(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, digest of the set, registers) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for part, data, offsets in K.pieces(batch, "text"):
                own, bounds = shingle_sets(data, offsets)
                raw = own.tobytes()
                digest = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                regs = sketches(own, bounds)
                yield pa.RecordBatch.from_arrays(
                    [K.column(part, "doc_id"), pa.array(np.diff(bounds), pa.int64()), K.binaries(digest), K.binaries([r.astype("<u2").tobytes() for r in regs])], ["doc_id", "n_shingles", "digest", "registers"]
                )

    return _picked(docs, text, id).mapInArrow(run, "doc_id long, n_shingles long, digest binary, registers binary")


def set_table(docs: DataFrame) -> DataFrame:
    """(node, set) of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.pieces(batch, "text"):
                own, bounds = shingle_sets(data, offsets)
                raw = own.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([K.column(part, "doc_id"), K.binaries([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])], ["node", "set"])

    return docs.mapInArrow(run, "node long, set binary")


def bands(reps: DataFrame) -> DataFrame:
    """(key, band, doc_id): the bands of (doc_id, registers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = np.frombuffer(b"".join(K.column(batch, "registers").to_pylist()), "<u2").reshape(-1, REGISTERS)
            keys, full = band_keys(regs)
            ids = np.repeat(K.column(batch, "doc_id").to_numpy(), full.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(keys[full].view(np.int64)), pa.array(np.nonzero(full)[1].astype(np.int32)), pa.array(ids)], ["key", "band", "doc_id"])

    return reps.mapInArrow(run, "key long, band int, doc_id long")


def _least_estimate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Six standard deviations under the threshold; registers that densification copied count for nothing."""
    free = np.minimum(REGISTERS, np.minimum(n, m))
    return np.where(free < 30, -1.0, NUMERATOR / 100 - 6 * np.sqrt(0.1875 / np.maximum(1, free)))  # 0.1875: the variance at the threshold


class Joined:
    """Union-find over labels."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def cell_links(band: int, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, regs: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links between different components within a cell of a bucket, at most one less than it has components.

    ``side``: 0 and 1 if the cell compares two parts of a bucket, all 0 if it compares one with itself.  A pair is looked
    at only in the first band that it shares.  Sets are 32-bit hashes; what they may have lost to collisions is allowed
    for, so no link is missed, and links are verified on whole sets later.
    """
    n = len(ids)
    left, right = (np.triu_indices(n, 1)) if not side.any() else (x.ravel() for x in np.meshgrid(np.flatnonzero(side == 0), np.flatnonzero(side == 1), indexing="ij"))
    ok = (labels[left] != labels[right]) & (100 * np.minimum(sizes[left], sizes[right]) >= NUMERATOR * np.maximum(sizes[left], sizes[right]))
    left, right = left[ok], right[ok]
    found: list[tuple[float, int, int]] = []
    for k in range(0, len(left), 8192):
        i, j = left[k : k + 8192], right[k : k + 8192]
        same = regs[i] == regs[j]
        likely = np.flatnonzero(same.mean(1) >= _least_estimate(sizes[i], sizes[j]))
        first = same[likely][:, : BANDS * ROWS].reshape(len(likely), BANDS, ROWS).all(2).argmax(1) == band
        likely = likely[first]
        found += zip((-same[likely].mean(1)).tolist(), i[likely].tolist(), j[likely].tolist())
    out, whole = [], Joined()
    for _, i, j in sorted(found):
        if whole.find(int(labels[i])) != whole.find(int(labels[j])):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            both += int(sizes[i] - len(sets[i]) + sizes[j] - len(sets[j]))
            if 100 * both >= NUMERATOR * (sizes[i] + sizes[j] - both):
                # the 32-bit sets may flatter: only a verified link may stand for others, so nothing is skipped for it
                out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
                if both * 100 >= NUMERATOR * (sizes[i] + sizes[j] - both) + 200:
                    whole.join(int(labels[i]), int(labels[j]))
    return out


def _sides(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``table`` (node, ...) for either side, named x_... and y_...

    Many pairs may share their leader ``a``: its row goes once to each of at most SALTS parts of its pairs.
    """
    side = lambda end, p: table.select(F.col("node").alias(end), *(F.col(c).alias(f"{p}_{c}") for c in columns))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    left = salted.select("a", "salt").distinct().join(side("a", "x"), "a")
    return salted.join(side("b", "y"), "b").join(left, ["a", "salt"]).drop("salt")


def plausible(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The (a, b) whose sizes allow the similarity and whose estimate isn't over six standard deviations too low."""

    @F.pandas_udf("boolean")
    def near(n, m, rx, ry):
        import pandas as pd

        n, m = n.to_numpy(), m.to_numpy()
        ok = 100 * np.minimum(n, m) >= NUMERATOR * np.maximum(n, m)
        if len(n):
            a, b = (np.frombuffer(b"".join(r), "<u2").reshape(-1, REGISTERS) for r in (rx, ry))
            ok &= estimate(a, b, n, m) >= _least_estimate(n, m)
        return pd.Series(ok)

    both = _sides(pairs, sketch, ["n_shingles", "registers"])
    return both.filter(near("x_n_shingles", "y_n_shingles", "x_registers", "y_registers")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets (node, set) are similar enough."""

    @F.pandas_udf("boolean")
    def similar(x, y):
        import pandas as pd

        out = np.zeros(len(x), bool)
        for i, (u, v) in enumerate(zip(x, y)):
            u, v = np.frombuffer(u, "<u8"), np.frombuffer(v, "<u8")
            both = len(np.intersect1d(u, v, assume_unique=True))
            out[i] = 100 * both >= NUMERATOR * (len(u) + len(v) - both)
        return pd.Series(out)

    return _sides(pairs, sets, ["set"]).filter(similar("x_set", "y_set")).select("a", "b")


def _open_links(members: DataFrame, reps: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """(a, b) by ``cell_links`` over members (key, band, doc_id, label, n) of buckets with several components.

    A bucket of more than CELL members is dealt into parts, and each two parts meet in a cell of their own.  No pairs are
    made outside of a cell, and cells give at most a spanning forest.
    """
    parts = F.ceil(F.col("n") / CELL).cast("int")
    dealt = members.withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
    groups = max(1, size // 2048)

    def run(key, table):
        table = table.sort_by([("key", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("doc_id", "ascending")])
        cols = {c: table[c].to_numpy() for c in ("key", "lo", "hi", "mine", "doc_id", "label", "band", "n_shingles")}
        regs = np.frombuffer(b"".join(table["registers"].to_pylist()), "<u2").reshape(-1, REGISTERS)
        new = np.ones(len(regs), bool)
        new[1:] = (cols["key"][1:] != cols["key"][:-1]) | (cols["lo"][1:] != cols["lo"][:-1]) | (cols["hi"][1:] != cols["hi"][:-1])
        ends = np.append(np.flatnonzero(new), len(regs))
        raw = table["small"]
        out = []
        for i, j in zip(ends[:-1], ends[1:]):
            if len(np.unique(cols["label"][i:j])) > 1:
                own = [np.frombuffer(raw[k].as_py(), "<u4") for k in range(i, j)]
                side = (cols["mine"][i:j] != cols["lo"][i]).astype(int) if cols["lo"][i] != cols["hi"][i] else np.zeros(j - i, int)
                out += cell_links(int(cols["band"][i]), cols["doc_id"][i:j], cols["label"][i:j], cols["n_shingles"][i:j], regs[i:j], own, side)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    @F.pandas_udf("binary")
    def shortened(x):
        return x.map(lambda b: np.unique(np.frombuffer(b, "<u8").astype(np.uint32)).astype("<u4").tobytes())

    # sets are shortened before they are joined to the buckets
    small = sets.groupBy("node").agg(F.min("set").alias("set")).select(F.col("node").alias("doc_id"), shortened("set").alias("small"))
    one = small.join(reps.dropDuplicates(["node"]).select(F.col("node").alias("doc_id"), "n_shingles", "registers"), "doc_id")
    full = dealt.select("key", "band", "doc_id", "label", "mine", "lo", "hi").join(one, "doc_id")
    return full.withColumn("g", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(groups))).groupBy("g").applyInArrow(run, "a long, b long")


def components(links: DataFrame, work: Scratch) -> DataFrame:
    """(node, label): the smallest node that links reach, for nodes with links.  Rounds of minimum and pointer jumping."""
    both = work.keep(links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to"))).filter("node <> to").distinct(), "edges")
    labels = work.keep(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label")), "labels")
    while True:
        # the label of the label, then the smallest of the neighbours'
        jumped = labels.alias("l").join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left").select("node", F.least("label", "far").alias("label"), F.col("label").alias("was"))
        near = both.join(labels.select(F.col("node").alias("to"), "label"), "to").groupBy("node").agg(F.min("label").alias("near"))
        after = work.keep(jumped.join(near, "node").select("node", F.least("label", "near").alias("label"), (F.least("label", "near") != F.col("was")).alias("moved")), "labels")
        labels = after.select("node", "label")
        if after.filter("moved").limit(1).count() == 0:
            return labels


def link(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of lower-cased (A-Z) five-word shingles have a Jaccard similarity of 0.75 or more;
    component_id is the smallest id that links reach.  Null, empty and blank texts have no shingles and no links.  Rows
    with a null id take no part: their component_id is null and they are kept.  Rows with one id are one document for the
    links.  Further columns don't matter; no rows give no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    work = Scratch(spark, "neardup")
    whole = work.keep(sketch_table(docs, text, id), "sketch")
    rows = whole.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "digest")
    heavy = work.keep(frequent(rows, "digest"), "heavy")
    classes = work.keep(rows.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = whole.filter("doc_id is not null").join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    reps = work.keep(reps.select(F.col("doc_id").alias("node"), "n_shingles", "registers"), "reps")
    sketch = work.keep(whole.drop("registers"), "sizes")  # registers are wanted for representatives only
    work.drop(f"{work.root}/001-sketch")
    texts = _picked(docs, text, id)

    def sets_of(nodes: DataFrame) -> DataFrame:
        """The sets of some documents, from their texts."""
        few = nodes.count() <= BROADCAST_IDS
        own = texts.join(F.broadcast(nodes) if few else nodes, "doc_id", "left_semi")
        return work.keep(set_table(own).dropDuplicates(["node", "set"]), "sets")

    def confirm(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Links among candidate pairs."""
        likely = work.keep(plausible(pairs, reps) if sets is None else pairs, "likely")
        ends = likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct()
        out = work.keep(verified(likely, sets_of(work.keep(ends, "nodes")) if sets is None else sets), "links")
        work.release()
        return out

    # buckets of several members, by partial sums; at most HEAVY of them have 1/HEAVY of all rows
    banded = bands(reps.select(F.col("node").alias("doc_id"), "registers"))
    buckets = work.keep(banded.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    work.release()
    least = reps.count() * BANDS // HEAVY
    big, small = buckets.filter(F.col("n") > least), buckets.filter(F.col("n") <= least)
    led = banded.join(F.broadcast(big.select("key", "leader")), "key").unionByName(banded.join(F.broadcast(big.select("key")), "key", "left_anti").join(small.select("key", "leader"), "key"))
    led = work.keep(led, "members")
    work.release()

    def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components."""
        for end in ("a", "b"):
            pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")), end, "left").withColumn(f"l{end}", F.coalesce(f"l{end}", end))
        return pairs.filter("la <> lb").select("a", "b")

    # first each document with the leader of most of its buckets, then with its other leaders if that left them apart
    pairs = work.keep(led.filter("doc_id <> leader").groupBy(F.col("leader").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("n")), "pairs")
    links = confirm(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")))
    labels = components(links, work)
    more = confirm(across(pairs.select("a", "b"), labels))
    if more.limit(1).count():
        links = work.keep(links.unionByName(more), "links")
        labels = components(links, work)
    # what is left: buckets that hold several components, each pair of members across components in the first of its bands
    named = led.select("key", "band", "doc_id").join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    named = work.keep(named, "named")
    several = work.keep(named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("key", "n"), "several")
    hot = several.filter(F.col("n") > least)
    open_ = named.join(F.broadcast(hot), "key").unionByName(named.join(F.broadcast(hot.select("key")), "key", "left_anti").join(several.filter(F.col("n") <= least), "key"))
    open_ = work.keep(open_, "open")
    size = open_.count()
    if size:
        sets = sets_of(work.keep(open_.select("doc_id").distinct(), "nodes"))
        more = confirm(work.keep(_open_links(open_, reps, sets, size), "found").distinct(), sets)
        if more.limit(1).count():
            labels = components(work.keep(links.unionByName(more), "links"), work)
    final = classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component_id"))
    some = F.col("n_shingles") > 0
    inside = sketch.filter(some & F.col("doc_id").isNotNull()).select("doc_id", "n_shingles", "digest")
    found = lookup(inside, work.keep(final, "final"), "digest", heavy).select("doc_id", "n_shingles", "component_id")
    apart = sketch.filter(~some | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(apart).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose document stays, the smallest id of each component; all columns unchanged."""
    own = fresh("__id", docs)
    stay = Scratch(docs.sparkSession, "kept").keep(link(docs, text, id).filter("kept").select(F.col("doc_id").alias(own)).distinct())
    return docs.alias("d").join(stay, F.col(f"d.{id}").cast("long").eqNullSafe(F.col(own)), "left_semi")


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
