"""What the driver holds at once."""

import tracemalloc

import numpy as np

from stratalake.llm import quality


def test_quality_fit_holds_one_table_of_terms():
    """A driver that has the counts needs room for little more than those."""
    counts = np.random.default_rng(9).integers(0, 3, (600, quality.TERMS)).astype(np.float32)
    y = (np.arange(600) % 2).astype(int)
    size = counts.nbytes
    want = quality.fit(counts.copy(), y)
    tracemalloc.start()
    got = quality.fit(counts, y, spend=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.2 * size
    for name in ("idf", "basis", "vectors", "labels", "weights"):
        assert np.array_equal(getattr(got, name), getattr(want, name))
