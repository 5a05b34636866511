"""Displacement and direction curves: transforms against direct sums, and tracks with gaps."""

import numpy as np
import pytest

from strandline.operators import tracks


@pytest.mark.parametrize("n", [2, 3, 4, 5, 8, 9, 64, 501, 2000])
def test_transforms_equal_direct_sums(n):
    rng = np.random.default_rng(n)
    y, x = 500 + np.cumsum(rng.normal(size=n)), -40 + np.cumsum(rng.normal(size=n))
    x[n // 2] = x[n // 2 - 1]
    y[n // 2] = y[n // 2 - 1]
    for curve in (tracks.squared_displacements, tracks.turning):
        direct, fast = curve(y, x), curve(y, x, 0)
        assert all(len(a) == len(direct[0]) for a in direct)
        for a, b in zip(direct, fast):
            assert np.allclose(a, b, rtol=1e-6, atol=1e-7 * (1 + np.abs(y - y.mean()).max() ** 2))
        lags, mean, _ = direct
        assert lags.tolist() == (list(range(1, n // 2)) if curve is tracks.squared_displacements else list(range(max(1, (n - 1) // 2))) if n >= 3 else [])
        if curve is tracks.squared_displacements:
            assert np.allclose(mean, [np.mean([(y[t + k] - y[t]) ** 2 + (x[t + k] - x[t]) ** 2 for t in range(n - k)]) for k in lags])


def test_tracks_with_gaps_and_keys(spark):
    rows = [("a", k, f, None if f % 5 == 2 else float(f * (k + 1)), float(k)) for k in range(3) for f in range(12 + k)] + [("b", 0, 0, 1.0, 1.0), (None, 7, 0, None, 2.0)]
    df = spark.createDataFrame(rows, "recording_id string, track_id long, frame int, cy double, cx double").repartition(4)
    got = {}
    for r in tracks.msd(df).collect():
        got.setdefault((r["recording_id"], r["track_id"]), {})[r["lag"]] = (r["msd"], r["sem"])
    for k in range(3):
        y = [f * (k + 1) for f in range(12 + k) if f % 5 != 2]
        want = {g: (pytest.approx(np.mean(d)), pytest.approx(np.std(d) / np.sqrt(len(d)))) for g in range(1, len(y) // 2) for d in [[(b - a) ** 2 for a, b in zip(y, y[g:])]]}
        assert got["a", k] == want
    assert set(got) == {("a", k) for k in range(3)}
    turned = {r["lag"]: r["autocorrelation"] for r in tracks.direction_autocorrelation(df).where("track_id = 1").collect()}
    assert turned == {k: pytest.approx(1.0) for k in range(4)}
    assert tracks.msd(df.limit(0)).count() == tracks.direction_autocorrelation(df.limit(0)).count() == 0
