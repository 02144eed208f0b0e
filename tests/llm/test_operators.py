"""Each operator against its plain version on awkward documents, on none, and on clashing columns."""

import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stratalake.llm import exact, kernels as K, lines, mixing, neardup, packing, substring, suffix, tiff
from stratalake.llm.tokens import WordTokenizer

from . import brute


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain(texts):
    return [(i, t) for i, t, _ in texts]


def distinct_ids(texts):
    seen = {}
    for i, t, _ in texts:
        if i is not None:
            seen.setdefault(i, t)
    return list(seen.items())


def test_exact_dedup(spark, docs, texts):
    assert rows(exact.exact_dedup(docs)) == sorted(brute.exact(plain(texts)), key=repr)


def test_exact_dedup_splits_heavy_keys(spark):
    """A third of the rows have one key; a tiny summary still finds it, and both ways give the same answer."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    heavy = exact.frequent(exact.digests(df), "digest", 4)
    assert 1 <= heavy.count() <= 4
    for k in (2, 1024):
        r = exact.exact_dedup(df, k=k).groupBy("group_size").count().collect()
        assert sorted(map(tuple, r)) == [(1, 2000), (1000, 1000)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=200), st.integers(1, 6))
def test_misra_gries_bound(values, k):
    m = exact.MisraGries(k)
    for i in range(0, len(values), 7):
        part = values[i : i + 7]
        m.add(sorted(set(part)), [part.count(x) for x in sorted(set(part))])
    assert len(m.count) <= k
    for x in set(values):
        assert values.count(x) - len(values) / (k + 1) <= m.count.get(x, 0) <= values.count(x)


def test_drop_copies(docs, texts):
    got = exact.drop_copies(docs)
    assert got.columns == docs.columns
    want = {(i, brute.lower(t or "")) for (i, t), r in zip(plain(texts), brute.exact(plain(texts))) if r[3]}
    assert sorted(((r.doc_id, brute.lower(r.text or "")) for r in got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("operator", [exact.drop_copies, neardup.keep_one, mixing.repeat])
def test_extra_columns_with_clashing_names(spark, operator):
    data = [(i, f"a b c d e f {i // 2}", "s", 77, 78, 79, 80) for i in range(8)]
    names = ["__id", "__sha", "__times", "__copy"]
    df = spark.createDataFrame(data, ["doc_id", "text", "source", *names])
    got, want = operator(df), operator(df.drop(*names))
    assert got.columns == df.columns and rows(got.select("doc_id", "text", "source")) == rows(want)
    assert got.select(*names).distinct().collect() == [(77, 78, 79, 80)]


def test_line_dedup(docs, texts):
    got = lines.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))
    assert rows(got) == sorted(brute.lines(plain(texts)), key=repr)


def test_line_dedup_uses_no_python(docs):
    plan = lines.line_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_line_dedup_with_a_hot_line(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line that all documents have\n"), F.col("id").cast("string")).alias("text"))
    r = lines.line_dedup(df).groupBy("n_dropped").count().collect()
    assert sorted(map(tuple, r)) == [(0, 1), (1, 499)]


@pytest.mark.parametrize("options", [{}, {"batches": 1}, {"batches": 5, "fan_out": 2, "block_bytes": 6000}])
def test_substring_dedup(docs, texts, options):
    got = substring.substring_dedup(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert rows(got) == sorted(brute.windows(plain(texts)), key=repr)


def test_substring_index_takes_batches_in_any_order(spark, unique_docs, texts):
    """What an earlier batch held is known to a later one, before and after compaction."""
    index = substring.FingerprintIndex(spark, bits=4)
    parts = [unique_docs.filter(f"doc_id % 3 = {k}") for k in (2, 0, 1)]
    order = {i: n for n, i in enumerate(i for k in (2, 0, 1) for i, _ in sorted(distinct_ids(texts)) if i % 3 == k)}
    want = {r[0]: r[2] for r in brute.windows([(order[i], t) for i, t in distinct_ids(texts)])}
    got = {}
    for p in parts:
        got |= {r.doc_id: r.n_removed for r in index.dedup(p).collect()}
        index.compact()
        assert len(index.runs) == 1
    assert {order[i]: n for i, n in got.items()} == want
    again = index.dedup(parts[0]).agg(F.sum("n_removed"), F.sum(F.greatest(F.lit(0), F.col("n_words")))).first()
    assert again[0] > 0


@pytest.mark.parametrize("options", [{}, {"batches": 5, "fan_out": 2, "block_bytes": 6000}])
def test_substring_matches_are_verified(docs, texts, options):
    """With sixteen bits many fingerprints belong to several windows; only the checks tell them apart."""
    got = substring.substring_dedup(docs, fingerprint_bits=16, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert rows(got) == sorted(brute.windows(plain(texts)), key=repr)


def test_substring_dedup_compacts_by_default(docs, texts, monkeypatch):
    runs, dedup = [], substring.FingerprintIndex.dedup
    monkeypatch.setattr(substring.FingerprintIndex, "dedup", lambda self, *a, **b: (dedup(self, *a, **b), runs.append(len(self.runs)))[0])
    got = substring.substring_dedup(docs, block_bytes=6000).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert rows(got) == sorted(brute.windows(plain(texts)), key=repr) and runs == [1, 2, 1, 2]


def test_packed_fingerprints_round_trip():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 64, 999, dtype=np.uint64))
    assert (substring.unpack(substring.pack(x)) == x).all() and len(substring.unpack(substring.pack(x[:0]))) == 0


@pytest.mark.parametrize("options", [{}, {"block_bytes": 9000}])
def test_suffix_dedup(docs, texts, options, monkeypatch):
    if options:
        monkeypatch.setattr(suffix, "RANGE_KEYS", 700)
    got = suffix.remove_repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert rows(got) == sorted(brute.repeats(plain(texts)), key=repr)


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 100, 300, dtype=np.uint8)
    a, b = (np.concatenate([rng.integers(97, 123, n, dtype=np.uint8), shared, rng.integers(97, 123, 50, dtype=np.uint8)]) for n in (77, 130))
    pa_, fa, oa = suffix.anchors(a, np.array([0, len(a)]))
    pb, fb, ob = suffix.anchors(b, np.array([0, len(b)]))
    for k in range(101):
        assert fa[oa[77 + k]] == fb[ob[130 + k]] and pa_[oa[77 + k]] - 77 == pb[ob[130 + k]] - 130


def test_near_duplicates(unique_docs, texts):
    assert rows(neardup.link(unique_docs)) == sorted(brute.near(distinct_ids(texts)), key=repr)


def test_near_duplicates_with_repeated_and_null_ids(docs, texts):
    want = {r[0]: r for r in brute.near(distinct_ids(texts))}
    got = neardup.link(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r) == want[r.doc_id] if r.doc_id is not None else (r.component_id is None and r.kept)


def test_near_duplicates_chains_and_thresholds(spark):
    """A chain links its ends though they aren't alike; just under the threshold there is no link."""
    base = [f"w{k}" for k in range(204)]
    chain = []
    for step in range(6):
        w = list(base)
        w[: step * 5] = [f"v{k}" for k in range(step * 5)]
        chain.append(" ".join(w))
    at = lambda n: " ".join(f"w{k}" for k in range(n + 4))  # noqa: E731  n shingles
    data = [(10 + i, t) for i, t in enumerate(chain)] + [(100, "z " + at(75)), (101, "y " + at(75)), (200, at(8).replace("w", "q")), (201, at(6).replace("w", "q"))]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert rows(neardup.link(df)) == sorted(brute.near(data), key=repr)


def test_near_duplicates_of_a_big_family(spark):
    """Many near copies: the links stay linear in their number."""
    import random

    rng = random.Random(1)
    base = [f"w{k}" for k in range(300)]
    data = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(300)] = f"x{rng.randrange(1000)}"
        data.append((i, " ".join(w)))
    got = neardup.link(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, _, c, _ in brute.near(data)}


def test_keep_one(unique_docs, texts):
    got = neardup.keep_one(unique_docs)
    assert got.columns == unique_docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(i for i, *_, kept in brute.near(distinct_ids(texts)) if kept)


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    common, a, b = (np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (3000, 500, 500))
    x, y = np.sort(np.concatenate([common, a])), np.sort(np.concatenate([common, b]))
    s = neardup.sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
    e = neardup.estimate(s[:1], s[1:], np.array([len(x)]), np.array([len(y)]))[0]
    assert abs(e - 0.75) < 0.1 and (neardup.sketches(np.zeros(0, np.uint64), np.array([0, 0])) == 0).all()
    one = neardup.sketches(x[:1], np.array([0, 1]))
    assert (one > 0).all() and len(set(one.ravel().tolist())) == 1


def test_rolling_hashes_are_polynomials_modulo_a_prime():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3 * K.CACHED + 17, dtype=np.uint8)
    roll, m = K.Rolling(5), K.Rolling.prime
    prefix, want, power = roll.prefix(data), 0, 1
    for i, byte in enumerate(data.tolist()):
        assert int(prefix[i]) == want
        want, power = (want + int(roll.code[byte]) * power) % m, power * roll.base % m
    assert int(prefix[-1]) == want
    twice = np.concatenate([data, data])
    p = roll.prefix(twice)
    start = rng.integers(0, len(data), 500)
    end = start + rng.integers(1, len(data), 500) % (len(data) - start + 1)
    assert (roll.ranges(p, start, end) == roll.ranges(p, start + len(data), end + len(data))).all()
    assert (roll.grams(p, 144)[: len(data) - 200] == roll.grams(p, 144)[len(data) : 2 * len(data) - 200]).all()
    edge = np.array([0, 1, m - 1, m - 1, 1 << 60], np.uint64)
    assert [int(x) for x in K.times61(edge, edge)] == [int(x) ** 2 % m for x in edge]


def thue_morse(n: int) -> tuple[str, str]:
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_hashes_tell_thue_morse_strings_apart(n):
    """Modulo 2^64 their polynomials agree for every odd base."""
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in thue_morse(n))
    for seed in range(20):
        roll = K.Rolling(seed)
        x, y = (roll.ranges(roll.prefix(v), np.array([0]), np.array([n]))[0] for v in (a, b))
        assert x != y


def test_operators_tell_thue_morse_strings_apart(spark):
    """Documents that are alike but for one long word, in front of 12 and of 4 others."""
    words = [[f"w{n}x{i}" for i in range(many)] for n in (1024, 2048) for many in (12, 4)]
    data = list(enumerate(" ".join([x, *rest]) for rest in words for n in (1024, 2048) for x in thue_morse(n)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = substring.substring_dedup(df, block_bytes=5000).withColumn("kept_text", F.sha2("kept_text", 256))
    assert rows(got) == sorted(brute.windows(data), key=repr)
    assert rows(neardup.link(df)) == sorted(brute.near(data), key=repr)
    got = suffix.remove_repeats(df).withColumn("kept", F.sha2("kept", 256))
    assert rows(got) == sorted(brute.repeats(data), key=repr)


def test_word_kernels(texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t, _ in texts])], ["text"])
    for most in (1, 300, 1 << 20):
        got = []
        for _, data, offsets in K.pieces(batch, "text", most):
            w = K.Words(data, offsets)
            raw = data.tobytes()
            got += [[raw[a:b].decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.bounds[:-1], w.bounds[1:])]
        assert got == [brute.WORD.findall(t or "") for _, t, _ in texts]


def test_targets_and_flow():
    q = mixing.targets({"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 2, "c": 1})
    assert q == {"a": Fraction(375, 2), "b": 75, "c": Fraction(75, 2)}
    q = mixing.targets({"a": 10, "b": 1000, "c": 1000}, {"a": 5, "b": 2, "c": 1})
    assert q["a"] == 30 and sum(q.values()) == 2010 and q["b"] == 2 * q["c"]
    assert mixing.targets({"a": 0}, {"a": 1}) == {"a": 0} and mixing.targets({}, {}) == {}
    ab, a, b = frozenset("ab"), frozenset("a"), frozenset("b")
    f = mixing.flow({ab: 100, a: 50, b: 10}, {"a": Fraction(60), "b": Fraction(100)})
    assert f[a, "a"] == 50 and f[ab, "a"] == 10 and f[ab, "b"] == 90 and f[b, "b"] == 10
    # what is repeated costs more: the second round starts only when the first is full
    f = mixing.flow({ab: 100, a: 50}, {"a": Fraction(100), "b": Fraction(70)})
    used = {x: sum(v for (p, _), v in f.items() if p == x) for x in (ab, a)}
    assert sum(used.values()) == 170 and f[ab, "b"] == 70 and max(0, used[ab] - 100) + max(0, used[a] - 50) == 20


def test_flow_is_as_cheap_as_linear_programming_would_be():
    """Against all ways to split small quotas."""
    import itertools

    cap = {frozenset("ab"): 2, frozenset("a"): 1, frozenset("b"): 2}
    quota = {"a": 4, "b": 4}

    def cost(used):
        return sum(max(0, used[p] - k * cap[p]) for p in cap for k in (1, 2))

    f = mixing.flow(cap, {s: Fraction(q) for s, q in quota.items()})
    used = {p: sum(v for (x, _), v in f.items() if x == p) for p in cap}
    best = min(
        cost({frozenset("ab"): x + y, frozenset("a"): 4 - x, frozenset("b"): 4 - y})
        for x, y in itertools.product(range(5), range(5)) if x + y <= 6 and 4 - x <= 3 and 4 - y <= 6
    )
    assert sum(used.values()) == 8 and cost(used) == best


def test_flow_of_single_members_takes_paths(monkeypatch):
    """Also without overlap words come along augmenting paths, level by level."""
    pushed, push = [], mixing.heapq.heappush
    monkeypatch.setattr(mixing.heapq, "heappush", lambda heap, x: (pushed.append(x), push(heap, x)))
    a, b, empty, none = frozenset("a"), frozenset("b"), frozenset("c"), frozenset([None])
    f = mixing.flow({a: 10, b: 100, empty: 0, none: 7}, {"a": Fraction(99), "b": Fraction(201, 2), "c": Fraction(0), None: Fraction(7)})
    assert {k: v for k, v in f.items() if v} == {(a, "a"): 30, (b, "b"): Fraction(201, 2), (none, None): 7} and pushed


def test_mix(docs, texts):
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts) and all(0 <= r.taken <= 3 * r.size for r in got)
    again = sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert sorted(map(str, got)) == again
    sizes = [len(brute.WORD.findall(t or "")) for _, t, _ in texts]
    assert sum(r["size"] for r in got) == sum(sizes)
    by = {}
    for r in got:
        by.setdefault(r.members[0], []).append(r)
    for own in by.values():
        assert own[0].source_size == sum(r["size"] for r in own) and abs(sum(r.taken for r in own) - own[0].target) <= 1 + max(r["size"] for r in own) * (own[0].source_size > 0) * 0.5
    assert sum(r.target for r in {r.members[0]: r for r in got}.values()) == pytest.approx(sum(sizes))


def test_mix_of_overlapping_sources(spark):
    df = spark.createDataFrame([(k, "w " * 10, [["a"], ["b"], ["a", "b"], [], None][k % 5]) for k in range(200)], "doc_id bigint, text string, source array<string>")
    got = mixing.mix(df, weights=(1, 1)).collect()
    assert len(got) == 200 and all(r.taken == 0 for r in got if not r.members) and sum(r.taken for r in got) == 1200


def test_repeat(docs):
    out = mixing.repeat(docs)
    assert out.columns == docs.columns and out.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 12


def test_tokens_word_by_word(texts):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole, own = Tokenizer.from_file(path), WordTokenizer(path, 50, 80)  # tables that overflow
    odd = ["<|endoftext|> x<|startoftext|>.", "don't I'LL 12. ab12!!", "É.é! x÷. '.s", "á̧ ΣαΣ.", "\x1c \x85 \xa0  ."]
    for t in [t or "" for _, t, _ in texts] + odd:
        assert np.frombuffer(own.ids(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.sampled_from(["norm", "dot"]), st.integers(1, 9), st.integers(64 * 64, 3 * 64 * 64))
def test_vector_best_fit_respects_every_constraint(lengths, score, documents, attention):
    cap = packing.Capacity(64, documents, float(attention), (1.0, 0.2, 0.3), score)
    where, offset = packing.vector_best_fit(np.array(lengths, np.int64), cap)
    for b in set(where.tolist()):
        own = [(o, n) for w, o, n in zip(where.tolist(), offset.tolist(), lengths) if w == b]
        assert sum(n for _, n in own) <= 64 and len(own) <= documents and sum(n * n for _, n in own) <= attention
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n


def test_best_fit_is_tight():
    n = np.random.default_rng(0).integers(1, 2049, 4000)
    where, _ = packing.vector_best_fit(n)
    assert where.max() + 1 <= 1.01 * n.sum() / 2048 + 1
    with pytest.raises(ValueError):
        packing.vector_best_fit(np.array([2049]))


def test_pack(docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs, packing.default_tokenizer(), group_pieces=7).toPandas()
    want = []
    for i, t, _ in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, p, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 2048))]
    have = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["length"].sum() <= 2048 and (own.offset.to_numpy() == np.r_[0, own["length"].to_numpy()[:-1].cumsum()]).all()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_round_trip(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_long_codecs_round_trip():
    rng = np.random.default_rng(0)
    for data in (bytes(rng.integers(0, 256, 30_000, dtype=np.uint8)), bytes(rng.integers(97, 99, 60_000, dtype=np.uint8)), b"q" * 70_000):
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data and tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data


def _tiff(order, tags, blobs):
    """A one-page file made by hand: ``blobs`` are put first, their places are the tag 273 or 324."""
    import struct

    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    places = []
    for b in blobs:
        places.append(len(out))
        out += b
    tags = {k: places if v == "places" else [len(b) for b in blobs] if v == "counts" else v for k, v in tags.items()}
    entries = b""
    for tag in sorted(tags):
        v = struct.pack(f"{order}{len(tags[tag])}I", *tags[tag])
        if len(v) > 4:
            at = struct.pack(f"{order}I", len(out))
            out += v
            v = at
        entries += struct.pack(f"{order}HHI", tag, 4, len(tags[tag])) + v
    struct.pack_into(f"{order}I", out, 4, len(out))
    return bytes(out + struct.pack(f"{order}H", len(tags)) + entries + b"\0\0\0\0")


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("bits", [8, 16, 32])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("planar", [1, 2])
@pytest.mark.parametrize("tiled", [False, True])
def test_tiff_layouts(order, bits, predictor, planar, tiled):
    rng = np.random.default_rng(bits)
    image = rng.integers(0, 1 << bits, (21, 19, 3), dtype=np.uint64).astype(f"u{bits // 8}")
    h, w = (16, 16) if tiled else (8, 19)
    blobs = []
    for planes in ([image] if planar == 1 else [image[:, :, k : k + 1] for k in range(3)]):
        for y in range(0, 21, h):
            for x in range(0, 19, w):
                part = planes[y : y + h, x : x + w]
                if tiled:
                    full = np.zeros((h, w, part.shape[2]), part.dtype)
                    full[: part.shape[0], : part.shape[1]] = part
                    part = full
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                blobs.append(zlib.compress(part.astype(part.dtype.newbyteorder(order)).tobytes()))
    tags = {256: [19], 257: [21], 258: [bits] * 3, 259: [8], 277: [3], 284: [planar], 317: [predictor]} | ({322: [w], 323: [h], 324: "places", 325: "counts"} if tiled else {273: "places", 278: [h], 279: "counts"})
    (page,) = tiff.pages(_tiff(order, tags, blobs))
    assert (page.width, page.height, page.samples, page.bits) == (19, 21, 3, bits)
    assert (np.frombuffer(page.data, f"<u{bits // 8}").reshape(21, 19, 3) == image).all()


def test_tiff_floating_point_predictor():
    x = np.random.default_rng(0).standard_normal((4, 6)).astype(np.float32)
    planes = np.ascontiguousarray(x.astype(">f4")).view(np.uint8).reshape(4, 6, 4).transpose(0, 2, 1).reshape(4, 24)
    raw = np.diff(planes, axis=1, prepend=np.zeros((4, 1), np.uint8)).tobytes()
    (page,) = tiff.pages(_tiff("<", {256: [6], 257: [4], 258: [32], 259: [1], 273: "places", 277: [1], 279: "counts", 317: [3]}, [raw]))
    assert (np.frombuffer(page.data, "<f4").reshape(4, 6) == x).all()


def test_tiff_faults_have_a_row(spark):
    good = tiff.encode(b"x" * 576 * 300)
    ring = bytearray(good)
    ring[-4:] = good[4:8]
    df = spark.createDataFrame([(1, bytearray(good), "p"), (2, bytearray(b"nothing"), "q"), (3, None, "r"), (4, bytearray(good[:-40]), "s"), (5, ring, "t"), (6, bytearray(b""), "u")], "doc_id bigint, media binary, page string")
    got = tiff.tiff_pages(df, keep=("doc_id", "page")).toPandas()
    assert sorted(got[got.error.isna()].doc_id.unique()) == [1, 5] or sorted(got[got.error.isna()].doc_id.unique()) == [1, 4, 5]
    assert sorted(got[got.error.notna()].doc_id) == [2, 4, 5, 6] and got.page_in.notna().all() and (got.doc_id == 1).sum() == 2


def test_media(docs, texts):
    media = tiff.text_to_tiff(docs).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    got = rows(tiff.payload_features(tiff.tiff_pages(media, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"))
    want = []
    for i, t, _ in texts:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        want.append((i, len(b), len(p), brute.sha(p), zlib.crc32(p[-32:])))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize(
    "run",
    [exact.exact_dedup, exact.drop_copies, lines.line_dedup, substring.substring_dedup, suffix.remove_repeats, neardup.link, neardup.keep_one, mixing.mix, mixing.repeat, tiff.text_to_tiff, lambda d: packing.pack(d, packing.default_tokenizer())],
)
def test_no_rows(no_docs, run):
    assert run(no_docs).count() == 0
