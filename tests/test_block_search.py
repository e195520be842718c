"""The search of a line of blocks at once, band by band."""

import numpy as np
import pytest

from blockloom.operators import search


@pytest.mark.parametrize("shape, radius, size, high", [((24, 24), 10, 8, 64), ((80, 64), 64, 8, 3), ((40, 30), 64, 8, 5000), ((32, 20), 9, 4, 255)])
def test_a_line_of_blocks_is_searched_at_once(shape, radius, size, high):
    samples = np.random.default_rng(3).integers(0, high, shape)
    for by in range(shape[0] // size):
        want = [search.nearest_copy(samples, by, bx, radius, size) for bx in range(shape[1] // size)]
        some = samples.astype(np.uint8) if high < 256 else samples
        assert search.line_copies(some, by * size, max(0, by * size - radius), radius, size).tolist() == [list(x) for x in want]


def test_block_search_does_not_send_each_line_to_nine_groups(spark, monkeypatch):
    """Lines travel with a band, and the bands' edges don't show."""
    samples = np.random.default_rng(4).integers(0, 9, (72, 24))
    plane = spark.createDataFrame([("e", y, row) for y, row in enumerate(samples.tolist())], "image_id string, y long, row array<int>")
    want = {(by, bx): search.nearest_copy(samples, by, bx, 16) for by in range(9) for bx in range(3)}
    for band in (2, 32):
        monkeypatch.setattr(search, "BAND", band)
        found = search.nearest_copies(plane, 16)
        assert {(r["by"], r["bx"]): (r["dx"], r["dy"], r["sad"]) for r in found.collect()} == want
