"""What the driver's Python holds while the ranking is fitted."""

import tracemalloc

import numpy as np

from palimpsest.llm import quality as Q


def test_the_fit_makes_no_copy_of_all_features():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 2 * Q.HASHED + 7), dtype=np.float32)
    good = rng.random(3000) < 0.8
    x[good, -1] += 1
    tracemalloc.start()
    try:
        w = Q.bradley_terry(x, good, pairs=5000)
        assert tracemalloc.get_traced_memory()[1] < x.nbytes
    finally:
        tracemalloc.stop()
    assert (x[good] @ w).mean() > (x[~good] @ w).mean()
