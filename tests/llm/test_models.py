"""The trained models against brute force: every labelling of short chains, numeric gradients of the risk."""

import itertools

import numpy as np
import pytest

from rangeloom.llm import quality, toxicity


def chain_objective(rows, x, y, w, m, ridge):
    """The weighted, penalized likelihood, summing over all labellings of each sequence."""
    total, labels = 0.0, [y[rows == r][0] for r in np.unique(rows)]
    counts = np.bincount(labels, minlength=2)
    for r in np.unique(rows):
        own, label = x[rows == r], y[rows == r]
        scores = own @ w
        score = lambda path: sum(scores[t, a] for t, a in enumerate(path)) + sum(m[a, b] for a, b in zip(path, path[1:]))  # noqa: E731,B023
        every = np.array([score(p) for p in itertools.product((0, 1), repeat=len(own))])
        weight = 0.5 / counts[label[0]] / len(own)
        total += weight * (score(list(label)) - np.logaddexp.reduce(every))
    return total - ridge / 2 * ((w**2).sum() + (m**2).sum())


def test_training_finds_the_chains_likeliest_weights():
    rng = np.random.default_rng(3)
    lengths = [1, 3, 5, 2, 4, 3, 6]
    rows = np.repeat(np.arange(len(lengths)), lengths)
    y = np.array([0, 1, 1, 0, 0, 1, 0])[rows]
    x = np.column_stack([np.ones(len(rows)), rng.standard_normal((len(rows), 2)) + y[:, None]])
    ridge = 0.05
    w, m = quality.train_chain(rows, x, y, steps=4000, rate=0.01, ridge=ridge, most_move=5.0)
    best, step = chain_objective(rows, x, y, w, m, ridge), 1e-4
    for a in (w, m):
        for at in np.ndindex(a.shape):
            held = a[at]
            sides = []
            for move in (step, -step):
                a[at] = held + move
                sides.append(chain_objective(rows, x, y, w, m, ridge))
            a[at] = held
            assert abs(sides[0] - sides[1]) / (2 * step) < 2e-3 and max(sides) <= best + 1e-6


def risk(w, positive, unlabelled, prior, ridge, nonnegative=True):
    z = lambda rows: np.array([w[r.astype(int)].sum() for r in rows]) + w[-1]
    zp, zu = z(positive), z(unlabelled)
    below = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    upper = prior * np.logaddexp(0, -zp).mean()
    return (upper + below if below >= 0 else -below) + ridge / 2 * (w[:-1] ** 2).sum(), below


@pytest.mark.parametrize("prior", [0.1, 0.9])
def test_first_step_goes_down_the_non_negative_risk(prior):
    """Adam's first step is `rate` against the sign of the gradient, which is taken numerically here."""
    rng = np.random.default_rng(5)
    width, rate, ridge = 6, 0.05, 5e-5
    draw = lambda n, p: [np.flatnonzero(rng.random(width) < p).astype(np.uint32) for _ in range(n)]
    positive, unlabelled = draw(30, 0.7), draw(50, 0.2)
    if prior > 0.5:  # the estimate of the second part goes below zero here
        unlabelled = [r[:0] for r in unlabelled]
        positive = [np.arange(width, dtype=np.uint32) for _ in positive]
    start = np.zeros(width + 1)
    start[-1] = np.log(prior / (1 - prior))
    weights, bias = toxicity.train(toxicity.Sparse(positive, width), toxicity.Sparse(unlabelled, width), prior, epochs=1, rate=rate, ridge=ridge)
    moved = np.append(weights, bias) - start
    for k in range(width + 1):
        ends = []
        for side in (1e-5, -1e-5):
            w = start.copy()
            w[k] += side
            ends.append(risk(w, positive, unlabelled, prior, ridge)[0])
        slope = (ends[0] - ends[1]) / 2e-5
        assert abs(slope) < 1e-7 or moved[k] == pytest.approx(-rate * np.sign(slope), rel=1e-3)
