"""The registered queries over superposed frames, on the given tables, against numpy."""

import collections

import numpy as np
import pytest

from ensemblespark.plans import registry
from ensemblespark.plans.views import view
from tests.test_suite import onto, spread

DATA = "/root/testdata/sf0.001"


def test_distances_of_superposed_frames(spark):
    points = collections.defaultdict(dict)
    for r in view(spark, DATA, "frames_v").collect():
        points[r.ensemble_id, r.frame_idx][r.res_idx] = (r.x, r.y, r.z)
    frames = collections.defaultdict(list)
    for (e, _), p in sorted(points.items()):
        frames[e].append([p[k] for k in sorted(p)])
    target = np.array(frames[0][0])
    x = {e: onto(np.array(v), target) for e, v in frames.items()}
    rows = {r.ensemble_id: r for r in registry.QUERIES["pairwise_rmsd_superposed"](spark, DATA).collect()}
    assert set(rows) == set(x)
    for e, v in x.items():
        own = spread(v, v)
        assert rows[e].own == pytest.approx(own, abs=2e-5) and rows[e].error == pytest.approx(abs(own - spread(x[0], x[0])), abs=2e-5)
        assert rows[e].debiased == pytest.approx(own * len(v) / (len(v) - 1), abs=2e-5)
        assert rows[e].across == (None if e == 0 else pytest.approx(spread(v, x[0]), abs=2e-5))
    got = {(r.ensemble_id, r.frame_idx, r.other): r.total for r in registry.QUERIES["frame_pair_rmsd_superposed"](spark, DATA).collect()}
    for e, v in x.items():
        for f in range(0, len(v), 7):
            for name, other in (("own", v), ("reference", x[0])):
                if e or name == "own":
                    assert got[e, f, name] == pytest.approx(np.sqrt(((v[f] - other) ** 2).sum((1, 2)) / 21).sum(), abs=1e-3)
    assert len(got) == sum(len(v) * (2 if e else 1) for e, v in x.items())
