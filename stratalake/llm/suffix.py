"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

A string is *repeated* if the same ``length`` bytes start at another place, in the same document or another one.

1. **Anchors.**  In every run of ``length`` bytes the first smallest of its 144-byte hashes is its anchor (winnowing), so
   equal strings have equal anchors at equal places.  A string whose anchor occurs once in the corpus occurs once itself;
   what is left are *units*: stretches of starts, cut at places that depend on their bytes alone, with the bytes their
   strings reach.
2. **Collapse.**  Equal units (128 bits of BLAKE2b) are counted.  One that occurs twice has repeated strings only, and goes on
   once, as a partner for others: a group of a thousand copies costs as much as one.  Anchors are then counted again among
   what is left.
3. **Sampled suffixes.**  The sample of the difference cover modulo 3 are the places p with p mod 3 in {1, 2}.  The triple of
   22-byte symbols that starts at each (66 bytes) is sorted over all tasks by ranges of its 64-bit key.  A key is its own
   name: it has the order and the equalities of its rank, so that no ranks have to be kept or sent back.  Names recurse
   once, as the triple of names at p, p+66 and p+132 (198 bytes); longer prefixes can't matter.  A name that occurs once
   can't be in a repeated string and leaves the recursion: between rounds a block keeps its bytes and one bit for each
   sampled place.  The order of names is that of keys, not of the alphabet: neighbours are all that is needed.
4. **Merge.**  Two suffixes are compared at the first offset (0, 1 or 2) where both are sampled, by the bytes before it, the
   name there, and the bytes behind it up to ``length``.  After the sort, neighbours with equal keys share ``length`` bytes.

Every exchange has the same shape: a block of documents sends its distinct keys, sorted, to ranges of the key space; a range
merges what all blocks sent and answers each block in the order of its keys.  A key is sent once by a block however often
it occurs there, so no range holds more of one key than there are blocks.  Messages number blocks times ranges, which is
the square of the input; so a key is sent as 64 bits (only units have 128), ranges hold a million of them, an answer is a bit
or two for each key, and messages go to Python many at a time.
"""

from __future__ import annotations

import ctypes
import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels as K
from .store import Scratch, byte_batches
from .substring import block_bounds

LENGTH = 200
GRAM = 144
BLOCK_BYTES = 2 << 20
RANGE_KEYS = 1 << 20
CUT_BITS = 5  # one of 32 repeated anchors ends a unit
_A = K.Rolling(101)
REPLY = "bucket int, block int, n int, flags binary"
SENT = "bucket int, block int, k1 binary, k2 binary, many binary"
REPEATED, OWNER = 1, 2


def _slide(x: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + w]; as long as there are w values."""
    done, out = 1, x
    while 2 * done <= w:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(x) - w + 1], out[w - done : w - done + len(x) - w + 1]) if w > done else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, fingerprints, starts' anchors): the first smallest gram of each string of ``length`` bytes.

    The last has, for each byte that starts a string, the number of the string's anchor, and -1 for other bytes.  It
    depends on the string's bytes alone, so equal strings have equal anchors at equal offsets.
    """
    n = len(data)
    own = np.full(n, -1, np.int32)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), own
    p = _A.prefix(data)
    h = _A.grams(p, GRAM)
    low = _slide((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1, np.minimum) & np.uint64(0xFFFFFFFF)
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(low)]
    start = np.flatnonzero(np.arange(len(low)) + length <= end)
    at = low[start].astype(np.int64)  # rising
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    own[start] = np.cumsum(new) - 1
    place = at[new]
    return place, h[place], own


def _ordered(table: pa.Table) -> pa.RecordBatch:
    """A block's rows in an order that depends on their values alone."""
    table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)


def _tidy() -> None:
    """Give freed memory back to the system: idle workers would keep what their largest group took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _planes(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes: the upper planes of small ones vanish when compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a row differs from the one before); the order of rows of two numbers is stable."""
    by = np.argsort(keys) if keys.ndim == 1 else np.lexsort(keys.T[::-1])
    new = np.ones(len(keys), bool)
    s = keys[by]
    new[1:] = s[1:] != s[:-1] if keys.ndim == 1 else (s[1:] != s[:-1]).any(1)
    return by, new


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, whether each occurs more than once, place of each key among them)."""
    if not len(keys):
        return keys, np.zeros(0, bool), np.zeros(0, np.int32)
    by, new = _sorted(keys)
    group = np.cumsum(new, dtype=np.int32) - np.int32(1)
    inverse = np.empty(len(keys), np.int32)
    inverse[by] = group
    return keys[by[new]], np.bincount(group) > 1, inverse


def _send(block: int, keys: np.ndarray, many: np.ndarray, cuts: np.ndarray) -> pa.Table:
    """Distinct keys by ranges of their first part; ``cuts`` are the first values of all ranges but the first."""
    first = keys if keys.ndim == 1 else keys[:, 0]
    ends = np.concatenate([[0], np.searchsorted(first, cuts, "left"), [len(keys)]])
    full = np.flatnonzero(np.diff(ends))
    rows = [slice(a, b) for a, b in zip(ends[full].tolist(), ends[full + 1].tolist())]
    steps = np.diff(first, prepend=np.uint64(0))
    steps[ends[full]] = first[ends[full]]
    more = [b""] * len(rows) if keys.ndim == 1 else [_planes(np.ascontiguousarray(keys[s, 1])) for s in rows]
    return pa.table({
        "bucket": pa.array(full.astype(np.int32)), "block": pa.array(np.full(len(rows), block, np.int32)),
        "k1": K.binaries([_planes(steps[s]) for s in rows]), "k2": K.binaries(more), "many": K.binaries([np.packbits(many[s]).tobytes() for s in rows]),
    })


def _merge(owned: bool = False) -> Callable:
    """Answers each block's keys: whether the corpus has the key twice; ``owned``, for keys of two numbers: whether the block
    is the first that has it."""

    def run(key, table):
        _tidy()
        bucket = key[0].as_py()
        order = np.argsort(table["block"].to_numpy(), kind="stable")
        blocks = table["block"].to_numpy()[order]
        parts, many = [], []
        for i in order.tolist():
            k1, k2 = np.cumsum(_unplanes(table["k1"][i].as_py(), "<u8"), dtype=np.uint64), table["k2"][i].as_py()
            parts.append(np.stack([k1, _unplanes(k2, "<u8")], 1) if k2 else k1)
            many.append(np.unpackbits(np.frombuffer(table["many"][i].as_py(), np.uint8))[: len(k1)].view(bool))
        ends = np.cumsum([0, *map(len, parts)]).tolist()
        keys, more = np.concatenate(parts), np.concatenate(many)
        del parts, many
        by, new = _sorted(keys)  # equal keys of two numbers stay in the order of their blocks
        del keys
        group = np.cumsum(new, dtype=np.int32) - np.int32(1)
        twice = np.bincount(group) > 1
        twice[group[more[by]]] = True
        flags = np.empty(len(by), np.uint8)
        flags[by] = twice[group] * np.uint8(REPEATED) + (new * np.uint8(OWNER) if owned else np.uint8(0))
        del by, new, group
        spans = list(zip(ends[:-1], ends[1:]))
        bits = lambda x: np.packbits(x & REPEATED > 0).tobytes() + (np.packbits(x & OWNER > 0).tobytes() if owned else b"")
        return pa.table({
            "bucket": pa.array([bucket] * len(spans), pa.int32()), "block": pa.array(blocks, pa.int32()), "n": pa.array([b - a for a, b in spans], pa.int32()),
            "flags": K.binaries([bits(flags[a:b]) for a, b in spans]),
        })

    return run


def _reply(back: pa.Table) -> np.ndarray:
    """Flags in the order in which the block sent its keys."""
    flags = [np.zeros(0, np.uint8)]
    for i in np.argsort(back["bucket"].to_numpy(), kind="stable").tolist():
        n, bits = back["n"][i].as_py(), np.frombuffer(back["flags"][i].as_py(), np.uint8)
        size = -(-n // 8)
        flag = np.unpackbits(bits[:size])[:n] * np.uint8(REPEATED)
        flags.append(flag + np.unpackbits(bits[size:])[:n] * np.uint8(OWNER) if len(bits) > size else flag)
    return np.concatenate(flags)


def _even(ranges: int) -> np.ndarray:
    """First values of equal ranges of 64-bit hashes."""
    return np.array([k * (2**64 // ranges) for k in range(1, ranges)], np.uint64)


# -- what a block does -------------------------------------------------------------------------------------------------


def _units(offsets: np.ndarray, place: np.ndarray, fps: np.ndarray, own: np.ndarray, repeated: np.ndarray, cut: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(first start, last start + 1) of the units of a piece: runs of starts whose anchor occurs again."""
    n = len(own)
    good = np.concatenate([repeated, [False]])[own]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    if cut:
        first[place[repeated & ((fps >> np.uint64(61 - CUT_BITS)) & np.uint64((1 << CUT_BITS) - 1) == 0)]] = True
    begin = good.copy()
    begin[1:] &= ~good[:-1] | first[1:]
    stop = good
    stop[:-1] &= ~good[1:] | first[1:]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def _frag_ends(sizes: np.ndarray) -> np.ndarray:
    """For each byte of the joined fragments, where its fragment ends."""
    return np.repeat(np.cumsum(sizes), sizes)


#: Bytes of a symbol of the sampled triples, and of a triple; names of triples, in threes, then cover 3 * TRIPLE bytes.
SYMBOL = 22
TRIPLE = 3 * SYMBOL
COVERS = 3 * TRIPLE


def _one_key(*parts: np.ndarray) -> np.ndarray:
    """A tuple of numbers as one 64-bit key."""
    x = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        x = K.mix(x * np.uint64(0x9E3779B97F4A7C15) + p + np.uint64(1))
    return x


def _chunks(sizes: np.ndarray, most: int = K.PIECE_BYTES) -> Iterator[tuple[np.ndarray, int, int]]:
    """(sizes, first byte, last + 1) of fragments in groups of about ``most`` bytes, so that kernels need little memory."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        a = int(ends[i] - sizes[i])
        j = max(i + 1, int(np.searchsorted(ends, a + most, "right")))
        yield sizes[i:j], a, int(ends[j - 1])
        i = j


def _chunk_anchors(data: np.ndarray, sizes: np.ndarray, length: int) -> Iterator[tuple]:
    """(first byte, offsets, places, fingerprints, starts' anchors) of fragments in groups."""
    for own, a, b in _chunks(sizes):
        offsets = np.concatenate([[0], np.cumsum(own)])
        yield a, offsets, *anchors(data[a:b], offsets, length)


def _sampled(state: dict) -> Iterator[tuple]:
    """(sizes, first byte, last + 1, places, keys, names) of fragments in groups: the sampled places that may still be part of
    a repeated string, their keys, and the names of all bytes (0: none) on the level before, or on the last one."""
    levels = [np.unpackbits(x).view(bool) for x in state["repeated"]]
    done = [0] * len(levels)
    for sizes, a, b in _chunks(state["sizes"]):
        x, ends, names = np.arange(b - a), _frag_ends(sizes), None
        sample = np.flatnonzero((x - ends + np.repeat(sizes, sizes)) % 3 != 0)
        at = sample[sample + TRIPLE <= ends[sample]]
        # the three symbols of a place lie side by side, so their tuple is the run of bytes
        keys = _A.ranges(_A.prefix(state["data"][a:b]), at, at + TRIPLE)
        for level, repeated in enumerate(levels):
            more = repeated[done[level] : done[level] + len(at)]
            done[level] += len(at)
            names = np.zeros(b - a + 3, np.uint64)
            names[at[more]] = np.maximum(keys[more], np.uint64(1))
            if level == 0:
                at = sample[sample + COVERS <= ends[sample]]
                at = at[(names[at] > 0) & (names[at + TRIPLE] > 0) & (names[at + 2 * TRIPLE] > 0)]
                keys = _one_key(names[at], names[at + TRIPLE], names[at + 2 * TRIPLE])
        yield sizes, a, b, at, keys, names


def _triples(state: dict) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) of the sampled places that may still be part of a repeated string."""
    keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for _, a, _, at, own, _ in _sampled(state):
        keys.append(own)
        places.append((at + a).astype(np.int32))
    return np.concatenate(keys), np.concatenate(places)


def _final(state: dict, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, starts): up to two keys for a start, compared where it and its partner are both sampled."""
    keys, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for sizes, a, b, _, _, names in _sampled(state):
        data, ends = state["data"][a:b], _frag_ends(sizes)
        s = np.flatnonzero(np.arange(b - a) + length <= ends)
        rest = (s - (ends - np.repeat(sizes, sizes))[s]) % 3
        for ahead, classes in ((0, (1, 2)), (1, (0, 1)), (2, (0, 2))):
            x = s[np.isin(rest, classes)]
            x = x[names[x + ahead] > 0]
            other = np.full(len(x), ahead + 1, np.uint64)
            for k in [*range(ahead), *range(ahead + COVERS, length)]:
                other = (other << np.uint64(8)) | data[x + k].astype(np.uint64)
            keys.append(_one_key(names[x + ahead], other))
            who.append((x + a).astype(np.int32))
    return np.concatenate(keys), np.concatenate(who)


class SuffixSort:
    """Rounds of exchange over a table of block states (block, n, payload): pickled arrays made by this module."""

    def __init__(self, spark: SparkSession):
        self.spark, self.work = spark, Scratch(spark, "suffix")

    def exchange(self, states: DataFrame, keys: Callable[[dict], tuple[np.ndarray, np.ndarray]], apply: Callable[[dict, np.ndarray, np.ndarray], dict], total: int, name: str, owned: bool = False) -> DataFrame:
        """Send ``keys(state)``, merge, and store ``apply(state, places, flags)``; see ``_merge`` for ``owned``."""
        with byte_batches(self.spark):
            return self._exchange(states, keys, apply, total, name, owned)

    def _exchange(self, states, keys, apply, total, name, owned) -> DataFrame:
        cuts = _even(max(1, -(-total // RANGE_KEYS)))

        def send(batches):
            for batch in batches:
                for block, p in zip(batch.column(0).to_pylist(), batch.column(1)):
                    _tidy()
                    k, many, _ = _distinct(keys(pickle.loads(p.as_py()))[0])
                    for b in _send(block, k, many, cuts).combine_chunks().to_batches():
                        yield b

        merged = states.select("block", "payload").mapInArrow(send, SENT).groupBy("bucket").applyInArrow(_merge(owned), REPLY)
        back = self.work.keep(merged, f"{name}_reply")

        def receive(key, table, replies):
            _tidy()
            out = []
            for block, p in zip(table["block"].to_pylist(), table["payload"]):
                state = pickle.loads(p.as_py())
                k, at = keys(state)
                _, _, inverse = _distinct(k)
                out.append((block, apply(state, at, _reply(replies)[inverse])))
            return pa.table({"block": pa.array([b for b, _ in out], pa.int32()), "n": pa.array([s["n"] for _, s in out], pa.int64()), "payload": K.binaries([pickle.dumps(s, 5) for _, s in out])})

        found = states.select("block", "payload").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(receive, "block int, n long, payload binary")
        kept = self.work.keep(found, name)
        self.work.discard(back, states)
        self.work.release()
        return kept


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", id: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept (binary, the bytes that stay).

    Texts are UTF-8 bytes; null is empty; strings don't cross documents.  Repeated rows are documents of their own, so all
    their strings are repeated.  Null ids are as good as others.  Further columns don't matter; no rows give no rows.
    ``length`` must be 200: the levels of the recursion are made for it.
    """
    if length != LENGTH:
        raise ValueError("the recursion's levels cover 200 bytes")
    spark = docs.sparkSession
    sort = SuffixSort(spark)
    work = sort.work
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    bounds, many = block_bounds(rows, block_bytes)
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bounds = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def block_of(ids):
        import pandas as pd

        at = np.searchsorted(bounds, ids.fillna(0).to_numpy().astype(np.int64), "left")
        return pd.Series(np.where(ids.isna(), many, at).astype(np.int32))

    dealt = rows.withColumn("block", block_of("doc_id"))
    cuts = _even(max(1, -(-size // 25 // RANGE_KEYS)))

    def send_anchors(key, table):
        _tidy()
        parts = [anchors(data, offsets, length)[1] for _, data, offsets in K.pieces(_ordered(table), "text")]
        k, many, _ = _distinct(np.concatenate([np.zeros(0, np.uint64), *parts]))
        return _send(key[0].as_py(), k, many, cuts)

    with byte_batches(spark):
        back = work.keep(dealt.groupBy("block").applyInArrow(send_anchors, SENT).groupBy("bucket").applyInArrow(_merge(), REPLY), "anchors")
    work.release()

    def find_units(key, table, replies):
        _tidy()
        found = [(data, offsets, *anchors(data, offsets, length)) for _, data, offsets in K.pieces(_ordered(table), "text")]
        _, _, inverse = _distinct(np.concatenate([np.zeros(0, np.uint64), *(f[3] for f in found)]))
        repeated = (_reply(replies)[inverse] & REPEATED) > 0
        done, docs_done = 0, 0
        doc, begin, sizes, digests, bytes_ = [], [], [], [], []
        for data, offsets, place, own, which in found:
            a, b = _units(offsets, place, own, which, repeated[done : done + len(own)])
            done += len(own)
            if len(a):
                e = b + length - 1
                d = np.searchsorted(offsets, a, "right") - 1
                doc.append(d + docs_done)
                begin.append(a - offsets[d])
                sizes.append(e - a)
                raw = data.tobytes()
                units_ = [raw[i:j] for i, j in zip(a.tolist(), e.tolist())]
                digests += [hashlib.blake2b(x, digest_size=16).digest() for x in units_]
                bytes_ += units_
            docs_done += len(offsets) - 1
        cat = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int32)
        keys = np.frombuffer(b"".join(digests), "<u8").astype(np.uint64).reshape(-1, 2)
        distinct, twice, inverse = _distinct(keys)
        one = np.zeros(len(distinct), np.int64)
        one[inverse[::-1]] = np.arange(len(keys))[::-1]  # the first unit of each kind
        state = {"doc": cat(doc), "begin": cat(begin), "size": cat(sizes), "kind": inverse, "keys": distinct, "twice": twice, "bytes": b"".join(bytes_[i] for i in one.tolist()), "kind_size": cat(sizes)[one]}
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(distinct)], pa.int64()), "payload": K.binaries([pickle.dumps(state, 5)])})

    with byte_batches(spark):
        units = work.keep(dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(find_units, "block int, n long, payload binary"), "units")
    work.discard(back)
    work.release()
    n_units = units.agg(F.sum("n")).first()[0] or 0

    def unit_keys(state):  # one entry or two, so that a unit which the block has twice counts as two
        k = state["keys"]
        again = np.flatnonzero(state["twice"])
        return np.concatenate([k, k[again]]), np.concatenate([np.arange(len(k)), again])

    def own_units(state, at, flags):
        n = len(state["keys"])
        shared, owner = (flags[:n] & REPEATED) > 0, (flags[:n] & OWNER) > 0
        ends = np.cumsum(state["kind_size"])
        keep = np.flatnonzero(owner)
        data = b"".join(state["bytes"][ends[i] - state["kind_size"][i] : ends[i]] for i in keep.tolist())
        out = {k: state[k] for k in ("doc", "begin", "size", "kind")}
        return out | {"shared": shared, "kept_kind": keep, "data": np.frombuffer(data, np.uint8), "sizes": state["kind_size"][keep], "n": len(data)}

    states = sort.exchange(units, unit_keys, own_units, n_units, "owned", owned=True)

    def left_anchors(state):  # of the units that are left, each once
        fps = np.concatenate([np.zeros(0, np.uint64), *(f[3] for f in _chunk_anchors(state["data"], state["sizes"], length))])
        return fps, np.arange(len(fps), dtype=np.int32)

    def narrow(state, at, flags):
        """Only stretches whose anchors occur in another unit, or again in their own, can hold strings to find."""
        sizes, raw, done = state["sizes"], state["data"].tobytes(), 0
        first, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for base, offsets, place, fps, own in _chunk_anchors(state["data"], sizes, length):
            a, b = _units(offsets, place, fps, own, (flags[done : done + len(fps)] & REPEATED) > 0, cut=False)
            done += len(fps)
            first.append(a + base)
            last.append(b + base + length - 1)
        a, e = np.concatenate(first), np.concatenate(last)
        out = {k: state[k] for k in ("doc", "begin", "size", "kind", "shared", "kept_kind")}
        new = b"".join(raw[i:j] for i, j in zip(a.tolist(), e.tolist()))
        return out | {"repeated": [], "unit_sizes": sizes, "from": a.astype(np.int32), "data": np.frombuffer(new, np.uint8), "sizes": (e - a).astype(np.int32), "n": len(new)}

    states = sort.exchange(states, left_anchors, narrow, (states.agg(F.sum("n")).first()[0] or 0) // 25, "narrowed")
    for level in (0, 1):
        total = states.agg(F.sum("n")).first()[0] or 0

        def name(state, at, flags):
            more = (flags & REPEATED) > 0
            return state | {"repeated": [*state["repeated"], np.packbits(more)], "n": int(more.sum())}

        states = sort.exchange(states, _triples, name, total * 2 // 3 if level == 0 else total, f"names{level}")
    total = states.agg(F.sum("n")).first()[0] or 0

    def settle(state, starts, flags):
        hit = np.zeros(int(state["unit_sizes"].sum()), bool)
        found = starts[(flags & REPEATED) > 0]
        ends = np.cumsum(state["sizes"])
        part = np.searchsorted(ends, found, "right")
        if len(found):  # back from the stretches to the units
            hit[state["from"][part] + found - (ends - state["sizes"])[part]] = True
        return {k: state[k] for k in ("doc", "begin", "size", "kind", "shared", "kept_kind")} | {"sizes": state["unit_sizes"], "hit": np.packbits(hit), "n": 0}

    states = sort.exchange(states, lambda s: _final(s, length), settle, 2 * total, "settled")

    def mark(key, table, settled):
        _tidy()
        batch = _ordered(table)
        spans: dict[int, list[tuple[int, int]]] = {}
        for p in settled["payload"]:
            s = pickle.loads(p.as_py())
            ends = np.cumsum(s["sizes"])
            hit = np.unpackbits(s["hit"])
            place = {int(k): i for i, k in enumerate(s["kept_kind"])}
            for d, a, size, kind in zip(s["doc"].tolist(), s["begin"].tolist(), s["size"].tolist(), s["kind"].tolist()):
                if s["shared"][kind]:
                    spans.setdefault(d, []).append((a, a + size))
                elif (i := place.get(kind)) is not None:
                    own = np.flatnonzero(hit[ends[i] - size : ends[i]])
                    if len(own):
                        breaks = np.flatnonzero(np.diff(own) > 1)
                        first, last = own[np.r_[0, breaks + 1]], own[np.r_[breaks, len(own) - 1]]
                        spans.setdefault(d, []).extend((a + int(x), a + int(y) + length) for x, y in zip(first, last))
        ids, n, gone, runs, kept = K.column(batch, "doc_id").to_pylist() if batch.num_rows else [], [], [], [], []
        for d, t in enumerate(K.column(batch, "text").to_pylist() if batch.num_rows else []):
            raw = t.encode()
            out, at, many_ = [], 0, 0
            for a, b in sorted(spans.get(d, ())):
                if a > at or not many_:
                    out.append(raw[at:a])
                    many_ += 1
                at = max(at, b)
            out.append(raw[at:] if many_ else raw)
            n.append(len(raw))
            kept.append(b"".join(out))
            gone.append(len(raw) - len(kept[-1]))
            runs.append(many_)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept": K.binaries(kept)})

    return dealt.groupBy("block").cogroup(states.select("block", "payload").groupBy("block")).applyInArrow(mark, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
