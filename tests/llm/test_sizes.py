"""What the rounds of the suffix sort send and keep."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from stratalake.llm import suffix


def test_suffix_messages_are_small_and_their_answers_right():
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 1 << 64, 60_000, dtype=np.uint64)
    blocks = [rng.choice(pool, 40_000) for _ in range(3)]
    cuts = suffix._even(4)
    sent, inverse = [], []
    for block, keys in enumerate(blocks):
        distinct, many, back = suffix._distinct(keys)
        sent.append(suffix._send(block, distinct, many, cuts))
        inverse.append(back)
    n = sum(int(x.max()) + 1 for x in inverse)
    rows = pa.concat_tables(sent)
    assert sum(len(x.as_py()) for c in ("k1", "k2", "many") for x in rows[c]) < 9 * n
    replies = pa.concat_tables([suffix._merge()([pa.scalar(b)], rows.filter(pa.compute.equal(rows["bucket"], b))) for b in range(4)])
    assert sum(len(x.as_py()) for c in replies.column_names if pa.types.is_binary(replies[c].type) for x in replies[c]) < n / 4
    values, counts = np.unique(np.concatenate(blocks), return_counts=True)
    for block, keys in enumerate(blocks):
        flags = suffix._reply(replies.filter(pa.compute.equal(replies["block"], block)))[inverse[block]]
        assert ((flags & suffix.REPEATED > 0) == (counts[np.searchsorted(values, keys)] > 1)).all()


def test_suffix_state_between_rounds_is_bytes_and_bits():
    data = np.random.default_rng(8).integers(97, 123, 5000, dtype=np.uint8)
    state = {"data": np.concatenate([data, data]), "sizes": np.array([5000, 5000]), "repeated": []}
    for _ in range(2):
        keys, at = suffix._triples(state)
        assert len(keys) == len(at) and len(np.unique(keys)) == len(keys) // 2
        state["repeated"].append(np.packbits(np.ones(len(keys), bool)))
    assert sum(x.nbytes for x in state["repeated"]) < len(state["data"]) / 4
    keys, starts = suffix._final(state, 200)
    assert set(starts.tolist()) == {*range(4801), *range(5000, 9801)}
    values, counts = np.unique(keys, return_counts=True)
    assert (counts == 2).all()
