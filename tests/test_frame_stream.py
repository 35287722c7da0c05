"""Motion against the previous frame: bounded memory, ties, late frames, positions missing."""
import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from scangrid.streaming import frames


class State:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def chunks(at, frame_id, px, py, size=10_000):
    for k in range(0, len(at), size):
        s = slice(k, k + size)
        yield pd.DataFrame({"sequence": 7, "frame_id": frame_id[s], "ts": at[s].astype("datetime64[us]").astype("datetime64[ns]"),
                            "px": px[s], "py": py[s]})


def plain(prior, rows):
    for at, frame_id, px, py in sorted(rows):
        dt, speed, heading = None, 0.0, 0.0
        if prior is None:
            prior = (at, px, py)
        else:
            dt = (at - prior[0]) / 1e6
            if dt > 0:
                dx, dy = px - prior[1], py - prior[2]
                speed, heading = math.hypot(dx, dy) / dt, math.atan2(dy, dx)
                prior = (at, px, py)
        yield frame_id, dt, *(0.0 if math.isnan(v) else v for v in (speed, heading))
    yield prior


@pytest.mark.parametrize("ties", [3, 40, 1 << 40])
def test_motion_matches_a_plain_loop(ties, monkeypatch):
    monkeypatch.setattr(frames, "ROWS_OUT", 50)
    rng = np.random.default_rng(ties)
    state, prior = State(), None
    for _ in range(4):  # batches overlap in time, so some frames are late
        at, frame_id = rng.integers(0, ties, 120), rng.permutation(120)
        px, py = rng.normal(size=(2, 120))
        px[::17] = np.nan
        got = pd.concat(frames.follow_motion((7,), chunks(at, frame_id, px, py, 50), state))
        *want, prior = plain(prior, zip(at.tolist(), frame_id.tolist(), px.tolist(), py.tolist()))
        assert got.frame_id.tolist() == [w[0] for w in want] and (got.sequence == 7).all()
        for i, c in enumerate(("dt", "speed", "heading")):
            assert np.allclose(got[c].to_numpy(float), np.array([w[i + 1] for w in want], float), equal_nan=True, rtol=1e-12)
        assert np.allclose(state.get, prior, equal_nan=True) and all(type(v) is type(p) for v, p in zip(state.get, prior))


def test_motion_holds_few_bytes_a_frame():
    n = 400_000
    rng = np.random.default_rng(1)
    rows = chunks(rng.permutation(n) * 1000, np.arange(n), *rng.normal(size=(2, n)))
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        count = sum(len(out) for out in frames.follow_motion((7,), rows, State()))
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert count == n and peak < 70 * n


def test_motion_of_frames_without_time_or_number():
    at = np.array(["1970-01-01T00:00:02", "NaT", "1970-01-01T00:00:01"], "datetime64[us]")
    rows = pd.DataFrame({"sequence": 7, "frame_id": [None, 5.0, 3.0], "ts": at.astype("datetime64[ns]"), "px": [4.0, 9, 1], "py": 0.0})
    state = State()
    got = pd.concat(frames.follow_motion((7,), iter([rows.iloc[1:2]]), state))
    assert got.dt.isna().all() and got.speed.tolist() == [0] and not state.exists
    got = pd.concat(frames.follow_motion((7,), iter([rows]), state))
    assert got.frame_id.fillna(-1).tolist() == [3, -1, 5] and got.dt.fillna(-1).tolist() == [-1, 1, -1]
    assert got.speed.tolist() == [0, 3, 0] and state.get == (2_000_000, 4.0, 0.0)
