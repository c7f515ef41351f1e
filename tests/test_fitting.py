"""Fitters against brute force: every promise is measured, on keys and between them."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rangeloom.operators import fitting


def staircase(keys, counts):
    k = np.unique(np.array(keys, dtype=float))
    return k, np.cumsum(np.resize(np.array(counts, dtype=float), len(k)))


def check(segs, k, f, t):
    assert [s[0] for s in segs] == [0, *(s[1] for s in segs[:-1])] and segs[-1][1] == len(k)
    for i, j, coef, centre, scale, err in segs:
        assert err <= t + 1e-6
        end = k[j] if j < len(k) else k[-1]
        for x in np.linspace(k[i], end, 200):
            if x >= end and j < len(k):
                continue
            truth = f[np.searchsorted(k, x, side="right") - 1]
            assert abs(np.polynomial.polynomial.polyval((x - centre) / scale, coef) - truth) <= err + 1e-6


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=60), st.lists(st.integers(1, 30), min_size=1, max_size=60))
@pytest.mark.parametrize("method,degree", [("poly", 1), ("poly", 3), ("cone", 1), ("spline", 1), ("sliding", 1), ("pla", 1)])
def test_promises_hold_between_keys(method, degree, keys, counts):
    k, f = staircase(keys, counts)
    check(fitting.METHODS[method](k, f, 35.0, degree), k, f, 35.0)


def least_error(x, y):
    """The least largest residual of any line, by trying the slope of every pair of points."""
    a, b = np.triu_indices(len(x), 1)
    slopes = [(y[j] - y[i]) / (x[j] - x[i]) for i, j in zip(a, b) if x[j] != x[i]] or [0.0]
    return min(np.ptp(y - s * x) / 2 for s in slopes)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=2, max_size=40), st.lists(st.integers(1, 40), min_size=1, max_size=40), st.sampled_from([3.0, 20.0, 60.0]))
def test_optimal_lines_are_as_long_as_any_line(keys, counts, t):
    k, f = staircase(keys, counts)
    segs = fitting.optimal_lines(k, f, t)
    check(segs, k, f, t)
    for i, j, *_ in segs:
        if j < len(k):
            assert least_error(*fitting.steps(k, f, i, j + 1)) > t - 1e-9
    assert len(segs) <= len(fitting.greedy(k, f, t, 1)) and len(segs) <= len(fitting.cone(k, f, t))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-500, 500), min_size=2, max_size=40))
def test_lines_of_a_measure_are_as_long_as_any_line(values):
    k, v = np.arange(float(len(values))), np.array(values)
    for i, j, _, _, _, err in fitting.measure_lines(k, v, 50.0):
        assert err <= 50 + 1e-6
        assert j == len(k) or least_error(k[i : j + 1], v[i : j + 1]) > 50 - 1e-6


def test_bottom_up_covers_and_measures():
    k, f = staircase(range(0, 300, 3), [1, 5, 2])
    segs = fitting.bottom_up(k, f)
    check(segs, k, f, max(s[5] for s in segs))


def test_one_jump_larger_than_the_bound():
    k, f = np.array([0.0, 1.0, 2.0]), np.array([1.0, 1000.0, 1001.0])
    check(fitting.greedy(k, f, 2.0, 2), k, f, 2.0)


def test_line_needs_one_segment():
    k = np.arange(500.0)
    assert len(fitting.greedy(k, k + 1, 1.0, 1)) == 1
    assert len(fitting.cone(k, k + 1, 1.0)) == 1


def test_minimax_against_brute_force():
    x, y = np.array([0.0, 1.0, 2.0, 3.0]), np.array([0.0, 1.0, 0.0, 1.0])
    best = min(abs(y - (a + b * x)).max() for a in np.linspace(-1, 1, 81) for b in np.linspace(-1, 1, 81))
    assert abs(y - np.polynomial.polynomial.polyval(x, fitting.minimax(x, y, 1, 200))).max() <= best + 0.05


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1000, 1000), min_size=1, max_size=40))
@pytest.mark.parametrize("degree", [1, 2, 3])
def test_maxima_with_negative_measures(degree, values):
    k, v = np.arange(float(len(values))), np.array(values)
    for i, j, coef, centre, scale, err in fitting.measure_segments(k, v, 100.0, degree):
        assert err <= 100 + 1e-6
        x = np.linspace(k[i], k[j - 1], 50)
        top = np.polynomial.polynomial.polyval((x - centre) / scale, coef).max()
        assert top <= v[i:j].max() + err + 1e-6


@pytest.mark.parametrize("degree", [2, 3, 4])
def test_maxima_of_blocks_fitted_in_step(monkeypatch, degree):
    rng = np.random.default_rng(degree)
    sizes = (1, 2, 50, 300, 301)
    blocks = [(np.cumsum(rng.exponential(1, n)), rng.uniform(0, 490, n)) for n in sizes] + [(np.arange(700.0), np.sin(np.arange(700.0) / 90) * 400)]
    calls, fits = [], fitting._measure_fits
    monkeypatch.setattr(fitting, "_measure_fits", lambda *a: calls.append(len(a[2])) or fits(*a))
    together = fitting.measure_many([k for k, _ in blocks], [v for _, v in blocks], 50.0, degree)
    shared = len(calls)
    for (k, v), segs in zip(blocks, together):
        alone = fitting.measure_segments(k, v, 50.0, degree)
        assert [s[:2] for s in segs] == [s[:2] for s in alone] and segs[-1][1] == len(k)
        for i, j, coef, centre, scale, err in segs:
            at = np.polynomial.polynomial.polyval
            assert err <= 50 and np.abs(at((k[i:j] - centre) / scale, coef) - v[i:j]).max() <= err + 1e-9
            for a in range(i, j - 1):
                x = np.linspace(k[a], k[a + 1], 30)
                assert at((x - centre) / scale, coef).max() <= max(v[a], v[a + 1]) + err + 1e-6
    assert len(together[-1]) <= 12 and max(calls) > 3 and shared < (len(calls) - shared) * 0.7


def test_sliding_buffers_of_blocks_merged_in_step(monkeypatch):
    rng = np.random.default_rng(5)
    blocks = [(np.cumsum(rng.exponential(1, n)), np.cumsum(rng.integers(1, 30, n)).astype(float)) for n in (1, 2, 59, 60, 61, 400)]
    for t in (5.0, 40.0, 1e6):
        for (k, f), segs in zip(blocks, fitting.sliding_many([k for k, _ in blocks], [f for _, f in blocks], t)):
            check(segs, k, f, t)
            i = 0
            for a, b, coef, *_ in segs:  # the first segment that merging the buffer alone leaves, or a step less
                end = min(len(k), i + 60)
                _, j, want, *_ = fitting.bottom_up(k[i:end], f[i:end], t)[0]
                assert a == i and b - i in (j, max(1, j - 1)) and np.allclose(coef, want)
                i = b
