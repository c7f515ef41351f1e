"""Fitters for one block of a cumulative function, in numpy.

A cumulative function is a staircase: F(x) = f[i] on [k[i], k[i+1]).  A segment owns
[k[i], k[j]) and must stay within t of F on all of it, not at the keys alone.  So every
step counts with both of its ends, and a polynomial also at its stationary points
inside a step.  Whatever a fitter proposes, a segment is accepted by its measured error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Segment = tuple[int, int, np.ndarray, float, float, float]  # rows i..j-1, coefficients, centre, scale, error


def steps(k: np.ndarray, f: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of the steps of rows i..j-1; the last step ends at key j, if there is one."""
    right = k[i + 1 : j + 1] if j < len(k) else np.append(k[i + 1 : j], k[j - 1])
    return np.concatenate([k[i:j], right]), np.concatenate([f[i:j], f[i:j]])


def minimax(x: np.ndarray, y: np.ndarray, degree: int, rounds: int = 12, t: float | None = None) -> np.ndarray:
    """Ascending coefficients near the least largest residual: least squares, reweighted by residuals (Lawson).
    With t it ends as soon as a fit is within t, or as a weighted mean of squares, which no largest residual
    is below, shows that none is."""
    basis = np.vander(x, degree + 1, increasing=True)
    w, best, least = np.ones(len(x)) / len(x), None, np.inf
    for _ in range(rounds):
        root = np.sqrt(w)
        coef = np.linalg.lstsq(basis * root[:, None], y * root, rcond=None)[0]
        r = y - basis @ coef
        middle = (r.max() + r.min()) / 2
        coef[0] += middle
        size = np.abs(r - middle)
        if size.max() < least:
            best, least = coef, size.max()
        if t is not None and (least <= t or (w * r * r).sum() > 1.0001 * t * t):
            break
        total = (w * size).sum()
        if total <= 0:
            break
        w = w * size / total + 1e-12
    return best


def staircase_error(k: np.ndarray, f: np.ndarray, i: int, j: int, coef: np.ndarray, centre: float, scale: float) -> float:
    """The largest distance from F on the segment's keys and inside its steps."""
    x, y = steps(k, f, i, j)
    z = (x - centre) / scale
    err = np.abs(np.polynomial.polynomial.polyval(z, coef) - y).max()
    if len(coef) > 2:
        roots = np.roots(np.polynomial.polynomial.polyder(coef)[::-1])
        at = roots[np.abs(roots.imag) < 1e-12].real
        at = at[(at > z[0]) & (at < z[j - i - 1 :].max())]
        if len(at):
            step = np.clip(np.searchsorted((k[i:j] - centre) / scale, at, side="right") - 1, 0, j - i - 1)
            err = max(err, np.abs(np.polynomial.polynomial.polyval(at, coef) - f[i:j][step]).max())
    return float(err)


def _poly(k: np.ndarray, f: np.ndarray, i: int, j: int, degree: int, t: float | None = None) -> Segment:
    x, y = steps(k, f, i, j)
    centre, scale = float((x.min() + x.max()) / 2), float(max((x.max() - x.min()) / 2, 1e-12))
    if j - i == 1:
        coef = np.array([f[i]] + [0.0] * degree)
    else:
        base = y.mean()
        coef = minimax((x - centre) / scale, y - base, min(degree, j - i), t=t)
        coef = np.pad(coef, (0, degree + 1 - len(coef)))
        coef[0] += base
    return i, j, coef, centre, scale, staircase_error(k, f, i, j, coef, centre, scale)


class Corridor:
    """Lines through vertical intervals that come in order of x: whether one is left, and which.

    The steepest line still possible runs from the lower end of an earlier interval to the upper end of a
    later one, the flattest from an upper to a lower end; a line is left as long as the flattest isn't the
    steeper one.  Only the hulls of the ends can hold such an earlier end."""

    def __init__(self) -> None:
        self.low: list[tuple[float, float]] = []
        self.high: list[tuple[float, float]] = []
        self.flat, self.steep = -np.inf, np.inf

    def take(self, x: float, lo: float, hi: float) -> bool:
        """Takes in the interval [lo, hi] at x; if no line is left, nothing changes and False is returned."""
        steep, flat = self.steep, self.flat
        for a, b in reversed(self.low):
            if x > a:
                slope = (hi - b) / (x - a)
                if slope < steep:
                    steep = slope
            elif b > hi:
                return False
        for a, b in reversed(self.high):
            if x > a:
                slope = (lo - b) / (x - a)
                if slope > flat:
                    flat = slope
            elif b < lo:
                return False
        if flat > steep:
            return False
        self.steep, self.flat = steep, flat
        for hull, y, up in ((self.low, lo, 1), (self.high, hi, -1)):
            while hull and hull[-1][0] == x and up * (y - hull[-1][1]) >= 0:
                hull.pop()
            if hull and hull[-1][0] == x:
                continue
            while len(hull) > 1 and up * ((hull[-1][1] - hull[-2][1]) * (x - hull[-2][0]) - (y - hull[-2][1]) * (hull[-1][0] - hull[-2][0])) <= 0:
                hull.pop()
            hull.append((x, y))
        return True

    def line(self) -> tuple[float, float]:
        """(slope, intercept) of a line in the middle of those left."""
        slope = 0.0 if np.isinf(self.flat) or np.isinf(self.steep) else (self.flat + self.steep) / 2
        return slope, (max(y - slope * x for x, y in self.low) + min(y - slope * x for x, y in self.high)) / 2


def optimal_lines(k: np.ndarray, f: np.ndarray, t: float) -> list[Segment]:
    """The least number of lines that stay within t of the staircase: each takes in steps as long as any line does."""
    out, i, n = [], 0, len(k)
    xs, ys = k.tolist(), f.tolist()
    while i < n:
        corridor, j = Corridor(), i
        while j < n:
            lo, hi, right = ys[j] - t, ys[j] + t, (xs[j + 1] if j + 1 < n else xs[j]) - xs[i]
            before = (corridor.flat, corridor.steep, list(corridor.low), list(corridor.high)) if j > i else None
            if not corridor.take(xs[j] - xs[i], lo, hi):
                break
            if right > xs[j] - xs[i] and not corridor.take(right, lo, hi):
                corridor.flat, corridor.steep, corridor.low, corridor.high = before  # the step's left end alone was possible
                break
            j += 1
        slope, base = corridor.line() if j > i + 1 else (0.0, ys[i])
        coef = np.array([base, slope])
        out.append((i, j, coef, xs[i], 1.0, staircase_error(k, f, i, j, coef, xs[i], 1.0)))
        i = j
    return out


def greedy(k: np.ndarray, f: np.ndarray, t: float, degree: int) -> list[Segment]:
    """Longest segments from left to right: double the length while the error holds, then halve the rest.
    The last accepted end was always measured; a segment of one step always holds."""
    out, i, n = [], 0, len(k)
    while i < n:
        good = _poly(k, f, i, i + 1, degree, t)
        low, size = i + 1, 2
        while low < n:
            end = min(n, i + size)
            seg = _poly(k, f, i, end, degree, t)
            if seg[5] > t:
                break
            good, low, size = seg, end, size * 2
        high = min(n, i + size)
        while low < n and low + 1 < high:
            mid = (low + high) // 2
            seg = _poly(k, f, i, mid, degree, t)
            if seg[5] <= t:
                good, low = seg, mid
            else:
                high = mid
        out.append(good)
        i = good[1]
    return out


def cone(k: np.ndarray, f: np.ndarray, t: float) -> list[Segment]:
    """Lines through each segment's first step, as long as one slope serves all steps."""
    out, i, n = [], 0, len(k)
    while i < n:
        low, high, j = -np.inf, np.inf, i + 1
        # the first step itself: a slope must not leave it before the next key
        if j < n:
            dx = k[j] - k[i]
            low, high = -t / dx, t / dx
        while j < n:
            a = k[j] - k[i]
            b = (k[j + 1] if j + 1 < n else k[j]) - k[i]
            lo = max(low, (f[j] - f[i] - t) / a, (f[j] - f[i] - t) / b)
            hi = min(high, (f[j] - f[i] + t) / a, (f[j] - f[i] + t) / b)
            if lo > hi:
                break
            low, high, j = lo, hi, j + 1
        slope = (low + high) / 2 if j > i + 1 else 0.0
        coef = np.array([f[i], slope])
        out.append((i, j, coef, float(k[i]), 1.0, staircase_error(k, f, i, j, coef, float(k[i]), 1.0)))
        i = j
    return out


def spline(k: np.ndarray, f: np.ndarray, t: float) -> list[Segment]:
    """Knots on the data, each segment the line between its knots: as many steps as stay within t."""
    out, i, n = [], 0, len(k)

    def line(i: int, j: int) -> Segment:
        end = min(j, n - 1)
        slope = (f[end] - f[i]) / (k[end] - k[i]) if end > i and j - i > 1 else 0.0
        coef = np.array([f[i], slope])
        return i, j, coef, float(k[i]), 1.0, staircase_error(k, f, i, j, coef, float(k[i]), 1.0)

    while i < n:
        good, size = line(i, i + 1), 2
        while i + size // 2 < n:
            seg = line(i, min(n, i + size))
            if seg[5] > t:
                break
            good, size = seg, size * 2
        low, high = good[1], min(n, i + size)
        while low + 1 < high:
            mid = (low + high) // 2
            seg = line(i, mid)
            if seg[5] <= t:
                good, low = seg, mid
            else:
                high = mid
        out.append(good)
        i = good[1]
    return out


def _ols(k: np.ndarray, f: np.ndarray, i: int, j: int) -> Segment:
    x = k[i:j] - k[i]
    slope = 0.0 if j - i < 2 else float(((x - x.mean()) * (f[i:j] - f[i:j].mean())).sum() / max(((x - x.mean()) ** 2).sum(), 1e-300))
    coef = np.array([f[i:j].mean() - slope * x.mean(), slope])
    return i, j, coef, float(k[i]), 1.0, staircase_error(k, f, i, j, coef, float(k[i]), 1.0)


def _square(k: np.ndarray, f: np.ndarray, seg: Segment) -> float:
    i, j, coef, centre, _, _ = seg
    return float(((coef[0] + coef[1] * (k[i:j] - centre) - f[i:j]) ** 2).mean())


def bottom_up(k: np.ndarray, f: np.ndarray, t: float | None = None, start: int = 3) -> list[Segment]:
    """Least-squares lines over triples, merged pairwise where the merge leaves the segments' mean squared
    errors most alike, until their spread rises; with t, single steps, cheapest merges first while errors
    stay within t."""
    start = start if t is None else 1
    segs = [_ols(k, f, i, min(len(k), i + start)) for i in range(0, len(k), start)]
    merged = lambda a, b: _ols(k, f, a[0], b[1])
    pairs = [merged(a, b) for a, b in zip(segs, segs[1:])]
    squares = [_square(k, f, s) for s in segs]
    joint = [_square(k, f, p) for p in pairs]
    while pairs:
        if t is None:
            total, total2, n = sum(squares), sum(s * s for s in squares), len(squares)
            after = []
            for m, v in enumerate(joint):
                s = total - squares[m] - squares[m + 1] + v
                s2 = total2 - squares[m] ** 2 - squares[m + 1] ** 2 + v * v
                after.append(max(0.0, s2 / (n - 1) - (s / (n - 1)) ** 2))
            at = int(np.argmin(after))
            if after[at] > max(0.0, total2 / n - (total / n) ** 2):
                break
        else:
            cost = [v if p[5] <= t else np.inf for v, p in zip(joint, pairs)]
            at = int(np.argmin(cost))
            if cost[at] == np.inf:
                break
        segs[at : at + 2], squares[at : at + 2] = [pairs[at]], [joint[at]]
        del pairs[at], joint[at]
        for m in (at - 1, at):
            if 0 <= m < len(pairs):
                pairs[m] = merged(segs[m], segs[m + 1])
                joint[m] = _square(k, f, pairs[m])
    return segs


def _line_errors(k: np.ndarray, f: np.ndarray, a: np.ndarray, b: np.ndarray, stop: np.ndarray, base: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """staircase_error() of many lines: rows a..b-1 each, of those that end before `stop`."""
    at = np.minimum(a[:, None] + np.arange((b - a).max()), b[:, None] - 1)
    y, first = f[at], k[a][:, None]
    ends = (k[at], k[np.minimum(at + 1, stop[:, None] - 1)])
    return np.maximum(*(np.abs(base[:, None] + slope[:, None] * (x - first) - y).max(1) for x in ends))


def _ols_many(k: np.ndarray, f: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base at the first key, slope and mean squared error of the least-squares lines of rows a..b-1 each."""
    at, n = a[:, None] + np.arange((b - a).max()), b - a
    held = at < b[:, None]
    at = np.minimum(at, b[:, None] - 1)
    x, y = k[at] - k[a][:, None], f[at]
    mean = lambda c: (c * held).sum(1) / n
    xm, ym = mean(x), mean(y)
    dx = (x - xm[:, None]) * held
    slope = np.where(n < 2, 0.0, (dx * (y - ym[:, None])).sum(1) / np.maximum((dx * dx).sum(1), 1e-300))
    base = ym - slope * xm
    return base, slope, mean((base[:, None] + slope[:, None] * x - y) ** 2)


def _first_merged(k: np.ndarray, f: np.ndarray, i: np.ndarray, end: np.ndarray, t: float) -> np.ndarray:
    """Where the first segment of bottom_up() with t over rows i..end-1 ends, for many buffers that are merged in step."""
    width, lanes = int((end - i).max()), np.arange(len(i))
    slot = np.arange(width)
    stop = np.minimum(i[:, None] + slot + 1, end[:, None])  # a slot's segment ends there; merged slots are left alone
    prev = np.tile(slot - 1, (len(i), 1))
    cost = np.full((len(i), width), np.inf)

    def price(lane: np.ndarray, s: np.ndarray) -> None:
        """What it costs to merge the segments at slots s with the next ones."""
        mid = stop[lane, s]
        some = mid < end[lane]
        cost[lane[~some], s[~some]] = np.inf
        lane, s, mid = lane[some], s[some], mid[some]
        if len(lane):
            a, b = i[lane] + s, stop[lane, mid - i[lane]]
            base, slope, square = _ols_many(k, f, a, b)
            cost[lane, s] = np.where(_line_errors(k, f, a, b, end[lane], base, slope) <= t, square, np.inf)

    lane, s = np.nonzero(i[:, None] + slot + 1 < end[:, None])
    price(lane, s)
    while len(lanes):
        at = cost[lanes].argmin(1)
        going = cost[lanes, at] < np.inf
        lanes, at = lanes[going], at[going]
        gone = stop[lanes, at] - i[lanes]
        stop[lanes, at] = stop[lanes, gone]
        cost[lanes, gone] = np.inf
        after = stop[lanes, at] - i[lanes]
        inner = stop[lanes, at] < end[lanes]
        prev[lanes[inner], after[inner]] = at[inner]
        has = at > 0
        price(np.concatenate([lanes, lanes[has]]), np.concatenate([at, prev[lanes[has], at[has]]]))
    return stop[:, 0]


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays one behind the other, with the first row and the end of each."""
    ends = np.cumsum([len(p) for p in parts])
    return np.concatenate(parts).astype(float), ends - [len(p) for p in parts], ends


def sliding_many(ks: list[np.ndarray], fs: list[np.ndarray], t: float, buffer: int = 60) -> list[list[Segment]]:
    """sliding_bottom_up() of many blocks, in step: numpy's cost a call is shared by all of them."""
    k, first, last = _joined(ks)
    f = _joined(fs)[0]
    out: list[list[Segment]] = [[] for _ in ks]
    lanes, i = np.flatnonzero(last > first), first[last > first]
    while len(lanes):
        stop = last[lanes]
        end = np.minimum(stop, i + buffer)
        b = _first_merged(k, f, i, end, t)
        base, slope, _ = _ols_many(k, f, i, b)
        err = _line_errors(k, f, i, b, stop, base, slope)
        # the last step ends at a key that the buffer may not have held
        cut = (err > t) & (b - i > 1) & (end < stop)
        if cut.any():
            b = b - cut
            err = np.where(cut, _line_errors(k, f, i, b, stop, base, slope), err)
        for lane, x, y, c, m, e in zip(lanes, i, b, np.stack([base, slope], 1), k[i], err):
            out[lane].append((int(x - first[lane]), int(y - first[lane]), c, float(m), 1.0, float(e)))
        lanes, i = lanes[b < stop], b[b < stop]
    return out


def sliding_bottom_up(k: np.ndarray, f: np.ndarray, t: float, buffer: int = 60) -> list[Segment]:
    """Bottom-up over a sliding buffer: its leftmost segment is final, then the buffer is refilled."""
    return sliding_many([k], [f], t, buffer)[0]


METHODS: dict[str, Callable[[np.ndarray, np.ndarray, float, int], list[Segment]]] = {
    "poly": greedy,
    "pla": lambda k, f, t, d: optimal_lines(k, f, t),
    "cone": lambda k, f, t, d: cone(k, f, t),
    "spline": lambda k, f, t, d: spline(k, f, t),
    "bottom_up": lambda k, f, t, d: bottom_up(k, f),
    "sliding": lambda k, f, t, d: sliding_bottom_up(k, f, t),
}

#: Methods that fit many blocks in one call.
TOGETHER: dict[str, Callable[[list[np.ndarray], list[np.ndarray], float], list[list[Segment]]]] = {"sliding": sliding_many}


def measure_lines(k: np.ndarray, v: np.ndarray, t: float) -> list[Segment]:
    """The least number of lines that stay within t of the measure at each key."""
    out, i, n = [], 0, len(k)
    xs, ys = k.tolist(), v.tolist()
    while i < n:
        corridor, j = Corridor(), i
        while j < n and corridor.take(xs[j] - xs[i], ys[j] - t, ys[j] + t):
            j += 1
        slope, base = corridor.line() if j > i + 1 else (0.0, ys[i])
        err = float(np.abs(base + slope * (k[i:j] - k[i]) - v[i:j]).max())
        out.append((i, j, np.array([base, slope]), xs[i], 1.0, err))
        i = j
    return out


def measure_segments(k: np.ndarray, v: np.ndarray, t: float, degree: int) -> list[Segment]:
    """Greedy segments of a raw measure for maxima: within t of the value at each key, and between
    keys nowhere more than t above the larger neighbour."""
    return measure_many([k], [v], t, degree)[0]


def measure_many(ks: list[np.ndarray], vs: list[np.ndarray], t: float, degree: int) -> list[list[Segment]]:
    """measure_segments() of many blocks.  From degree 2 on they go in step, as numpy's cost a call is then shared
    by all of them: each block doubles and halves its segment on its own, the fits of a step are made at once."""
    if degree == 1:
        return [measure_lines(k, v, t) for k, v in zip(ks, vs)]
    k, first, last = _joined(ks)
    v = _joined(vs)[0]
    out: list[list[Segment]] = [[] for _ in ks]
    lanes, i = np.flatnonzero(last > first), first[last > first]
    # `low` ends the best fit so far, `high` is an end that did not fit, or -1
    low, high, size = i + 1, np.full(len(i), -1), np.full(len(i), 2)
    good = _alone(k, v, i, degree)
    while len(lanes):
        stop = last[lanes]
        end = np.where(high < 0, np.minimum(stop, i + size), (low + high) // 2)
        fitted = _measure_fits(k, v, i, end, t, degree)
        ok = fitted[:, -1] <= t
        good[ok] = fitted[ok]
        low, high = np.where(ok, end, low), np.where(ok, high, end)
        size = np.where(ok, size * 2, size)
        done = np.where(high < 0, low == stop, low + 1 >= high)
        if done.any():
            for lane, a, b, g in zip(lanes[done], i[done], low[done], good[done]):
                out[lane].append((int(a - first[lane]), int(b - first[lane]), g[:-3].copy(), float(g[-3]), float(g[-2]), float(g[-1])))
            i = np.where(done, low, i)
            left = i < stop
            lanes, i, low, high, size, good, done = (c[left] for c in (lanes, i, low, high, size, good, done))
            low[done], high[done], size[done] = i[done] + 1, -1, 2
            good[done] = _alone(k, v, i[done], degree)
    return out


def _alone(k: np.ndarray, v: np.ndarray, i: np.ndarray, degree: int) -> np.ndarray:
    """Rows of coefficients, centre, scale and error for segments of one key."""
    return np.column_stack([v[i], np.zeros((len(i), degree)), k[i], np.full(len(i), 1e-12), np.zeros(len(i))])


def _measure_fits(k: np.ndarray, v: np.ndarray, i: np.ndarray, end: np.ndarray, t: float, degree: int) -> np.ndarray:
    """Coefficients, centre, scale and error of one fit for rows i..end-1 each, made at once where lengths are alike."""
    out = np.empty((len(i), degree + 4))
    kind = np.digitize(end - i, [17, 129, 1025, 8193])
    for which in np.unique(kind):
        some = kind == which
        a, b = i[some], end[some]
        at = np.minimum(a[:, None] + np.arange((b - a).max()), b[:, None] - 1)  # the last row fills the lines up
        x, y, n = k[at], v[at], b - a
        centre, scale = (x[:, 0] + x[:, -1]) / 2, np.maximum((x[:, -1] - x[:, 0]) / 2, 1e-12)
        z = (x - centre[:, None]) / scale[:, None]
        coef = minimax_many(z, y, n, degree, t)
        err = np.abs(_values(coef, z) - y).max(1)
        near = np.flatnonzero(err <= t)
        err[near] = np.maximum(err[near], _overshoot(coef[near], z[near], y[near], n[near]))
        out[some] = np.column_stack([coef, centre, scale, err])
    return out


def _values(coef: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Each row's polynomial at its own z."""
    out = np.zeros_like(z)
    for c in coef.T[::-1]:
        out = out * z + c[:, None]
    return out


def minimax_many(z: np.ndarray, y: np.ndarray, n: np.ndarray, degree: int, t: float, rounds: int = 12) -> np.ndarray:
    """minimax() with t of many rows, whose first n entries count and whose last one is repeated behind them.  The
    weighted least squares go by polynomials orthogonal over a row's own weights, so no system is solved."""
    held = np.arange(z.shape[1]) < n[:, None]
    w = held / n[:, None]
    best, least, open_ = np.zeros((len(z), degree + 1)), np.full(len(z), np.inf), np.arange(len(z))
    for _ in range(rounds):
        coef, fit = np.zeros((len(z), degree + 1)), np.zeros_like(z)
        p, q, norm_q = np.ones_like(z), np.zeros_like(z), np.ones(len(z))
        pc, qc = np.zeros_like(coef), np.zeros_like(coef)
        pc[:, 0] = 1
        for d in range(degree + 1):
            wp = w * p
            norm = np.einsum("ij,ij->i", wp, p)
            use = (n > d) & (norm > 1e-26)
            norm = np.where(use, norm, 1.0)
            c = np.where(use, np.einsum("ij,ij->i", wp, y - fit) / norm, 0.0)
            fit = fit + c[:, None] * p
            coef += c[:, None] * pc
            if d < degree:
                alpha, beta = np.einsum("ij,ij,ij->i", wp, p, z) / norm, norm / norm_q if d else np.zeros(len(z))
                p, q = (z - alpha[:, None]) * p - beta[:, None] * q, p
                up = np.zeros_like(pc)
                up[:, 1:] = pc[:, :-1]
                pc, qc, norm_q = up - alpha[:, None] * pc - beta[:, None] * qc, pc, norm
        r = y - fit
        middle = (r.max(1) + r.min(1)) / 2
        coef[:, 0] += middle
        far = np.abs(r - middle[:, None])
        worst = far.max(1)
        better = worst < least[open_]
        best[open_[better]], least[open_[better]] = coef[better], worst[better]
        total = (w * far).sum(1)
        going = (least[open_] > t) & ((w * r * r).sum(1) <= 1.0001 * t * t) & (total > 0)
        if not going.any():
            break
        w = np.where(held[going], w[going] * far[going] / total[going, None] + 1e-12, 0.0)
        z, y, n, held, open_ = z[going], y[going], n[going], held[going], open_[going]
    return best


def _overshoot(coef: np.ndarray, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How far each row's polynomial rises above the larger neighbour at its stationary points between keys."""
    slope = coef[:, 1:] * np.arange(1, coef.shape[1])
    at = np.full((len(coef), slope.shape[1] - 1), np.nan)
    plain = np.abs(slope[:, -1]) > 1e-9 * np.abs(slope).max(1, initial=0.0)
    if plain.any():
        monic = slope[plain, :-1] / slope[plain, -1:]
        companion = np.zeros((len(monic), monic.shape[1], monic.shape[1])) + np.eye(monic.shape[1], k=-1)
        companion[:, :, -1] = -monic
        roots = np.linalg.eigvals(companion)
        at[plain] = np.where(np.abs(roots.imag) < 1e-12, roots.real, np.nan)
    for row in np.flatnonzero(~plain):
        roots = np.roots(np.trim_zeros(slope[row][::-1], "f"))
        real = roots[np.abs(roots.imag) < 1e-12].real
        at[row, : len(real)] = real
    inside = (at > z[:, :1]) & (at < z[:, -1:])
    at = np.where(inside, at, 0.0)
    # the padding repeats the last key, which no point inside reaches
    step = np.clip((z[:, None, :] <= at[:, :, None]).sum(2) - 1, 0, np.maximum(n - 2, 0)[:, None])
    top = np.maximum(np.take_along_axis(y, step, 1), np.take_along_axis(y, np.minimum(step + 1, z.shape[1] - 1), 1))
    return np.where(inside, _values(coef, at) - top, -np.inf).max(1, initial=-np.inf)
