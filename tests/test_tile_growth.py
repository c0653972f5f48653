"""Rings of many points are cut in time that grows with their points."""

import math
import time

from ballotlake.operators import tiles

from .test_places import RINGS, plain_tile


def test_a_ring_of_many_points_is_cut_in_time(spark):
    n = 10_000
    ring = [(10 + 9 * math.cos(2 * math.pi * k / n), 5 + 9 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    ring.append(ring[0])
    start = time.monotonic()
    rows = tiles.ring_features(spark.createDataFrame([(1, [ring])], f"id long, rings {RINGS}"), 5).collect()
    assert time.monotonic() - start < 40
    assert len(rows) > 1
    for r in rows:
        assert [[(p.x, p.y) for p in x] for x in r.rings] == plain_tile([ring], 5, r.tile_x, r.tile_y)
