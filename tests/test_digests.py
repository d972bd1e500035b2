import hashlib

import numpy as np
import pytest

from seriesmill.functions.digests import decimals, halves


@pytest.mark.parametrize("prefix", [b"", b"42|7|fold_1|", b"x" * 47, b"x" * 52, b"y" * 70])
def test_halves_are_those_of_the_library(prefix):
    numbers = np.concatenate([np.arange(0, 3000), 10 ** np.arange(0, 15), 10 ** np.arange(1, 15) - 1, np.arange(99_000, 101_000)])
    raw = b"".join(hashlib.md5(prefix + str(x).encode()).digest() for x in numbers.tolist())
    assert (halves(prefix, decimals(numbers)) == np.frombuffer(raw, ">u8").reshape(-1, 2)).all()
