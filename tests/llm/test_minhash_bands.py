"""Near duplicates at the threshold meet in a bucket."""

import numpy as np
import pytest

from prismal.llm import minhash


@pytest.mark.parametrize("seed", [4179, 11199, 16349, 20903, 26663])  # those of 29,895 seeds that meet in none of 25 bands
def test_pairs_at_the_threshold_meet(seed):
    a = np.random.default_rng(seed).integers(0, 1 << 63, 51).astype(np.uint64)
    both = [minhash.bands(minhash.signature(x)) for x in (a[:46], np.concatenate([a[:41], a[46:]]))]  # similarity 41 / 51
    assert (both[0] == both[1]).any()


def test_few_pairs_at_the_threshold_are_lost():
    assert (1 - minhash.LEAST**minhash.ROWS) ** minhash.BANDS < 1e-4
