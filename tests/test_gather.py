"""Small bricks are gathered a block at a time."""

import numpy as np
import pandas as pd

from voxelbrick.operators import bricks as B
from voxelbrick.operators import resample


def test_blocks_are_bounded():
    for brick in ((8, 8, 32), (4, 4, 4), (32, 32, 32), (64, 64, 64), (1, 512, 512)):
        many = resample.block_of(brick)
        assert many == (1, 1, 1) or np.prod(brick) * np.prod(many) <= resample.BLOCK
    assert resample.block_of((8, 8, 32)) == (8, 4, 1)


def test_sums_leave_a_block_once(spark):
    a, brick = np.arange(16 * 16 * 64, dtype=float).reshape(16, 16, 64), (8, 8, 32)
    rows = [B._row("v", 0, k, at, piece) for k, at, piece in B._cut("v", 0, np.zeros(3, int), a, brick)]
    b = spark.createDataFrame(rows, B.BRICKS)
    pieces = resample.sent(resample.with_transforms(b, resample.IDENTITY, (0, 0, 0), None), a.shape, a.shape, brick)
    kernel = lambda r, have: pd.DataFrame([(r.volume_id, resample.assembled(have, (r.z0, r.y0, r.x0), (r.z0 + r.nz, r.y0 + r.ny, r.x0 + r.nx)).sum(), 1.0)], columns=["volume_id", "s", "n"])
    out = resample.gathered(b, pieces, kernel, brick, "volume_id string, s double, n double", ("s", "n")).collect()
    assert len(out) == 2 and sum(r.n for r in out) == len(rows) == 8
    assert sum(r.s for r in out) == a.sum()
