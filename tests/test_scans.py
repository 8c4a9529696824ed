"""Vectorised recurrences against plain loops."""

import math
import time

import numpy as np
import pytest

from tidebars.functions.scans import affine_scan, clamp_scan, last_nonzero
from tidebars.operators.recursive import FollowLine, Vidya


def vidya(x, w, past):
    out = []
    for value, weight in zip(x.tolist(), w.tolist()):
        past = 0.0 if math.isnan(value) else weight * value + (1 - weight) * past
        out.append(math.nan if math.isnan(value) else past)
    return np.array(out)


def follow(outside, rise, fall, side, line):
    out = []
    for o, r, f in zip(outside.tolist(), rise.tolist(), fall.tolist()):
        side = o or side
        if r == r:
            line = max(r, line) if side > 0 else min(f, line) if side < 0 else line
        out.append(line)
    return np.array(out), side


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 4097])
def test_scans(n):
    draw = np.random.default_rng(n)
    scale, shift = draw.uniform(-1, 1, n), draw.normal(size=n)
    y, want = 2.5, []
    for a, b in zip(scale.tolist(), shift.tolist()):
        y = a * y + b
        want.append(y)
    assert np.allclose(affine_scan(scale, shift, 2.5), want, rtol=1e-12, atol=1e-12)
    low, high = np.where(draw.random(n) < 0.3, draw.normal(size=n), -np.inf), np.where(draw.random(n) < 0.3, draw.normal(size=n), np.inf)
    y, want = 0.5, []
    for a, b in zip(low.tolist(), high.tolist()):
        y = min(b, max(a, y))
        want.append(y)
    assert clamp_scan(low, high, 0.5).tolist() == want
    x, last, want = draw.integers(-1, 2, n), 7, []
    for v in x.tolist():
        last = v or last
        want.append(last)
    assert last_nonzero(x, 7).tolist() == want


def _line_rows(draw, n):
    outside = draw.choice([0.0, 0.0, 0.0, 1.0, -1.0], n)
    outside[: n // 5] = 0
    rise = draw.normal(100, 1, n)
    rise[: n // 10] = np.nan
    return {"pos": np.arange(n), "outside": outside, "rise_to": rise, "fall_to": rise + 2}


@pytest.mark.parametrize("cuts", [(500,), (90, 110, 300, 500), (1, 2, 3, 500)])
def test_stretches_chain(cuts):
    """Machines described and entered stretch by stretch give what one loop gives."""
    draw = np.random.default_rng(4)
    rows = _line_rows(draw, 500)
    x, w = draw.normal(50, 1, 500), draw.uniform(0, 1, 500)
    x[[0, 1, 200]] = np.nan
    machines = [(FollowLine(atr_period=5), rows, follow(rows["outside"], rows["rise_to"], rows["fall_to"], 0.0, 0.0)[0]), (Vidya({"y": ("x", "w")}), {"x": x, "w": w}, vidya(x, w, 0.0))]
    for machine, columns, want in machines:
        state, start, found = list(machine.state.values()), 0, []
        for end in cuts:
            part = {c: v[start:end] for c, v in columns.items()}
            found.append(machine.run(part, state)[0])
            state, start = machine.apply(state, machine.summarise(part)), end
        assert np.allclose(np.concatenate(found), want, rtol=1e-12, equal_nan=True)


def test_a_million_rows_without_a_loop():
    draw = np.random.default_rng(5)
    n = 1_000_000
    rows, x, w = _line_rows(draw, n), draw.normal(50, 1, n), draw.uniform(0, 1, n)
    line, average = FollowLine(atr_period=5), Vidya({"y": ("x", "w")})

    def best(call):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            call()
            took.append(time.perf_counter() - began)
        return min(took)

    fast = best(lambda: line.run(rows, [0.0, 0.0])) + best(lambda: average.run({"x": x, "w": w}, [0.0]))
    slow = best(lambda: follow(rows["outside"], rows["rise_to"], rows["fall_to"], 0.0, 0.0)) + best(lambda: vidya(x, w, 0.0))
    print(f"{fast:.3f} s, loop {slow:.3f} s")
    assert fast * 4 < slow  # a wide margin for a busy machine; 0.08 and 0.65 s were measured
