"""Smoothing, and the numeric kernels of circular binary segmentation (segmentation.py applies them)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import scan
from .stats import differences, inflation, trimmed_squares


def trimmed_variance(x: np.ndarray, trim: float = 0.025) -> float:
    d = np.sort(np.abs(np.diff(x)))
    keep = int(math.floor((1 - 2 * trim) * len(d) + 0.5))
    return inflation(trim) * float((d[:keep] ** 2).sum()) / (2 * keep) if keep else 0.0


def smooth(x: np.ndarray, chrom: np.ndarray | None = None, region: int = 10, outlier_sd: float = 4.0, smooth_sd: float = 2.0, trim: float = 0.025, sd: float | None = None) -> np.ndarray:
    """Outliers shrunk towards the median of their neighbours (within `region` places and the same chromosome run).

    A value stays if any neighbour lies within outlier_sd deviations, or if some neighbour lies above and some below it;
    above all of them it becomes the neighbourhood's median plus smooth_sd deviations, below all of them minus. A value
    without neighbours ends below itself. Values that aren't finite take no part. sd: the deviation, if it is known.
    """
    x = np.asarray(x, float)
    ok = np.flatnonzero(np.isfinite(x))
    if len(ok) < (2 if sd is None else 1):
        return x.copy()
    y, c = x[ok], np.zeros(len(ok)) if chrom is None else np.asarray(chrom)[ok]
    sd = math.sqrt(trimmed_variance(y, trim)) if sd is None else sd
    far, near = outlier_sd * sd, smooth_sd * sd
    out, edges = y.copy(), np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    for a, e in zip(edges, np.append(edges[1:], len(y)), strict=True):
        if e - a == 1:
            out[a] = y[a] - near if far > 0 else y[a]
            continue
        # A value as near as `far` to a neighbour at its side stays; only around the others windows are laid out.
        step = np.abs(np.diff(y[a:e])) > far
        apart = np.flatnonzero(np.append(True, step) & np.append(step, True)) if region else np.arange(e - a)
        padded = np.concatenate([np.full(region, np.nan), y[a:e], np.full(region, np.nan)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * region + 1)
        for i in range(0, len(apart), 50_000):  # a block of windows at a time
            at = apart[i : i + 50_000]
            around = windows[at]
            own = around[:, region].copy()
            around[:, region] = np.nan
            low, high = np.nanmin(around, 1), np.nanmax(around, 1)
            alone = np.nanmin(np.abs(around - own[:, None]), 1) > far
            k = np.flatnonzero(alone & ((own > high) | (own < low)))
            around[k, region] = own[k]
            out[a + at[k]] = np.nanmedian(around[k], 1) + np.where(own[k] > high[k], near, -near) if len(k) else 0
    x = x.copy()
    x[ok] = out
    return x


def least_weights(m: np.ndarray, lengths: Iterable[int]) -> np.ndarray:
    """For each length the least weight of that many neighbours on the circle; m: prefix sums of the weights, from 0."""
    n = len(m) - 1
    return np.array([min((m[k:] - m[: n + 1 - k]).min(), m[n] - (m[n - k :] - m[: k + 1]).max()) for k in lengths])


def _sums(x: np.ndarray, w: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Prefix sums of values and of weights, and the sum of squares."""
    y = x if w is None else w * x
    m = np.arange(len(x) + 1.0) if w is None else np.concatenate([[0.0], np.cumsum(w)])
    return np.concatenate([[0.0], np.cumsum(y)]), m, float((y * x).sum())


FINE = 16  # places in the parts of blocks


def _best_arc(s: np.ndarray, m: np.ndarray, al0: int, longest: int | None, floor: float = 0.0, enough: float = math.inf, share: tuple[int, int] = (0, 1), common: int = 4) -> tuple[float, int, int]:
    """The largest between-group sum of squares of an arc and its ends, of equal ones the shortest and first.

    Places are in blocks of about sqrt(n). The extremes of two blocks' prefix sums and the least and most weight between
    them bound the arcs from one to the other; pairs of blocks are opened by falling bound until none can be better. An
    opened pair's blocks are cut in parts of FINE places, whose pairs are bounded in the same way, so that near places,
    whose blocks' bounds are loose, cost FINE pairs each instead of sqrt(n).
    Arcs below `floor` aren't looked for, and the search ends at one of `enough`. share (k, n): the kth of n searches that
    together open all pairs; each opens the `common` most promising ones, so that all know a good arc early.
    """
    n, whole = len(s) - 1, m[-1]
    longest = min(n - al0, longest or n)
    best, at = 0.0, (0, n)
    if longest < al0:
        return best, *at
    block = max(16, math.isqrt(n))
    first = np.arange(0, n + 1, block)
    least = least_weights(m, [al0])[0]

    def bounds(first: np.ndarray, p: np.ndarray, q: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of blocks that may hold an arc to look for, and the most that one of it can be."""
        fits = (last[q] - first[p] >= al0) & (first[q] - last[p] <= longest)
        p, q = p[fits], q[fits]
        light, heavy = np.maximum(m[first[q]] - m[last[p]], least), np.minimum(m[last[q]] - m[first[p]], whole - least)
        under = np.minimum(light * (whole - light), heavy * (whole - heavy))
        bound = np.full(len(p), math.inf)
        np.divide(whole * np.maximum(high[q] - low[p], high[p] - low[q]) ** 2, under, out=bound, where=under > 0)
        open_ = bound * (1 + 1e-9) >= max(best, floor)
        return p[open_], q[open_], bound[open_]

    def blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.append(first[1:], n + 1) - 1, np.minimum.reduceat(s, first), np.maximum.reduceat(s, first)

    parts = np.unique(np.minimum(first[:, None] + np.arange(0, block, FINE), n))
    part_of, ends = np.searchsorted(parts, np.append(first, n + 1)), blocks(parts)
    steps, inner, places = np.arange(FINE), np.arange(-(-block // FINE)), np.arange(n + 1)
    p, q, bound = bounds(first, *np.triu_indices(len(first)), *blocks(first))
    ranked = np.argsort(-bound, kind="stable")
    ranked = ranked[(np.arange(len(ranked)) < common) | (np.arange(len(ranked)) % share[1] == share[0])]
    for at_once in (ranked[:common], *(ranked[k : k + 64] for k in range(common, len(ranked), 64))):
        o = at_once[bound[at_once] * (1 + 1e-9) >= max(best, floor)]
        if not len(o) or best >= enough:
            break
        u, v = np.broadcast_arrays(part_of[p[o]][:, None, None] + inner[:, None], part_of[q[o]][:, None, None] + inner)
        real = (u < part_of[p[o] + 1][:, None, None]) & (v < part_of[q[o] + 1][:, None, None]) & (u <= v)
        u, v, most_of = bounds(parts, u[real], v[real], *ends)
        order = np.argsort(-most_of, kind="stable")
        for x in (order[:4], *(order[k : k + 200] for k in range(4, len(order), 200))):
            x = x[most_of[x] * (1 + 1e-9) >= max(best, floor)]
            if not len(x):
                break
            i, j = parts[u[x]][:, None] + steps, parts[v[x]][:, None] + steps
            real = (i <= ends[0][u[x]][:, None])[:, :, None] & (j <= ends[0][v[x]][:, None])[:, None, :]
            i, j = np.minimum(i, n), np.minimum(j, n)
            k, d, size = (y[j][:, None, :] - y[i][:, :, None] for y in (places, s, m))
            left = whole - size
            value = np.zeros(k.shape)
            np.divide(whole * d * d, size * left, out=value, where=real & (k >= al0) & (k <= longest) & (size > 0) & (left > 0))
            most = float(value.max())
            if most > 0 and most >= best:
                length, start = min((int(k[z]), int(i[z[0], z[1]])) for z in map(tuple, np.argwhere(value == most)))
                if most > best or (length, start) < (at[1] - at[0], at[0]):
                    best, at = most, (start, start + length)
            if best >= enough:
                break
    return best, *at


def _statistic(best: float, t: float, n: int) -> float:
    t = best + 1 if t <= best + 1e-4 else t
    return best * (n - 2) / (t - best)


def largest_arc(x: np.ndarray, al0: int, w: np.ndarray | None = None, longest: int | None = None, tss: float | None = None) -> tuple[float, int, int]:
    """The arc (i, j] with the largest between-group sum of squares: its F-like statistic and its ends (i < j <= n).

    Arcs and their complements hold al0 values at least; with `longest`, arcs hold that many at most. With weights, means,
    lengths and sums are weighted. x must have (weighted) mean zero.
    """
    s, m, t = _sums(x, w)
    best, i, j = _best_arc(s, m, al0, longest)
    return _statistic(best, t if tss is None else tss, len(x)), i, j


def reaches(x: np.ndarray, al0: int, stat: float, w: np.ndarray | None = None, longest: int | None = None) -> bool:
    """Whether the largest arc's statistic is `stat` or more; arcs that can't be are passed over by their bounds."""
    s, m, t = _sums(x, w)
    need = stat * t / (len(x) - 2 + stat)
    return _statistic(_best_arc(s, m, al0, longest, need * (1 - 1e-6), need * (1 + 1e-6))[0], t, len(x)) >= stat


def nu(v: float, tol: float = 1e-6) -> float:
    """The correction of a Brownian crossing probability for discrete steps."""
    if v <= 0.01:
        return math.exp(-0.583 * v)
    phi = NormalDist().cdf
    total, k, step, term = math.log(2) - 2 * math.log(v), 0, 2, 1.0
    while term > tol and k < 100_000:
        inc = sum(phi(-v * math.sqrt(j) / 2) / j for j in range(k + 1, k + step + 1))
        total, k, step = total - 2 * inc, k + step, step * 2
        term = abs(2 * inc / total) if total else 0
    return math.exp(total)


def tail(b: float, delta: float, m: int, grid: int = 100, tol: float = 1e-6) -> float:
    """Tail probability of the largest arc statistic over arcs of a share of delta or more."""
    h = (0.5 - delta) / grid
    area = 0.0
    for k in range(grid):
        t = 0.5 - (k + 0.5) * h
        x = b / math.sqrt(m * t * (1 - t))
        area += nu(x, tol) ** 2 / (t * (1 - t)) ** 2 * h
    return 2 * area * b**3 * math.exp(-b * b / 2) / (4 * math.sqrt(2 * math.pi))


def boundary_tail(b: float, m: int, grid: int = 100, tol: float = 1e-6) -> float:
    """Tail probability of the largest statistic of a single change, up or down, among m values, two or more on either side:
    crossings in both directions and the last place's two tails."""
    at = b * math.sqrt(1 / (m - 2) - 1 / m), b * math.sqrt(1 / 2 - 1 / m)
    x = np.linspace(*at, grid + 1)
    y = np.array([nu(v + b * b / (m * v), tol) / v for v in x])
    return 2 * b * math.exp(-b * b / 2) * float(np.trapezoid(y, x)) / math.sqrt(2 * math.pi) + 2 * (1 - NormalDist().cdf(b))


def permutation_p(a: np.ndarray, b: np.ndarray, nperm: int, rng: np.random.Generator) -> float:
    """Two-sided permutation p value of the difference of two groups' means; groups of one value count as equal."""
    n1, n2 = len(a), len(b)
    if n1 == 1 or n2 == 1:
        return 1.0
    both = np.concatenate([a, b])
    n, mean, tss = n1 + n2, both.mean(), float(((both - both.mean()) ** 2).sum())
    small = a if n1 <= n2 else b
    m = len(small)
    d = abs(small.mean() - mean)
    bss = d * d * m * n / (n - m)
    t = bss / (((tss if tss > bss + 1e-4 else bss + 1) - bss) / (n - 2))
    if t > 25 and m >= 10:
        return 0.0
    hits = sum(abs(rng.permutation(both)[:m].mean() - mean) >= 0.99999 * d for _ in range(nperm))
    return hits / nperm


def weighted_permutation_p(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, nperm: int, rng: np.random.Generator) -> float:
    """permutation_p with weights. What is permuted are the first group's values times the roots of their weights and
    the second's as they are; a drawn value is weighed by the root of its new place, at the end."""
    n1, n2 = len(a), len(b)
    if n1 == 1 or n2 == 1:
        return 1.0
    root, n, total = np.sqrt(np.concatenate([wa, wb])), n1 + n2, wa.sum() + wb.sum()
    sums = (wa * a).sum(), (wb * b).sum()
    mean = (sums[0] + sums[1]) / total
    tss = (wa * a * a).sum() + (wb * b * b).sum() - total * mean * mean
    m, small, other, mass = (n1, wa.sum(), wb.sum(), sums[0]) if n1 <= n2 else (n2, wb.sum(), wa.sum(), sums[1])
    d = 0.99999 * abs(mass / small - mean)
    t = d * d * small * total / other
    if m >= 10 and t / ((tss - t) / (n - 2)) > 25:
        return 0.0
    both, ends = np.concatenate([a * root[:n1], b]), root[n - m :]
    hits = sum(abs((rng.permutation(both)[:m] * ends).sum() / small - mean) >= d for _ in range(nperm))
    return hits / nperm


def draws(seed: int, a: int, e: int) -> Callable[[int], np.random.Generator]:
    """Random numbers of the kth permutation of the values a..e-1: counted, so that they don't depend on what was drawn
    before, nor where."""
    return lambda k: np.random.Generator(np.random.Philox(key=[seed, a << 32 | e], counter=[0, 0, 0, k]))


@cache
def stopping(nperm: int, limit: int, eta: float) -> tuple[int, ...]:
    """Of a test that fails at more than `limit` hits in nperm permutations: after how many of them it may end with
    success, if 0, 1, ..., limit were hits. Permutations with just one hit more than that end wrongly with a probability of
    at most eta.

    For j hits it ends where so few have a probability of e at most by the hypergeometric distribution; e is the largest
    (by bisection) for which all ends together stay within eta, summed over the ways the hits can fall.
    """
    bad = limit + 1
    none = tuple([nperm] * bad)
    if eta <= 0 or bad > nperm:
        return none
    few = np.array([[math.comb(n, j) * math.comb(nperm - n, bad - j) / math.comb(nperm, bad) for j in range(bad)] for n in range(nperm + 1)]).cumsum(axis=1)

    def ends(e: float) -> list[int]:
        return [int(np.argmax(few[:, j] <= e)) if (few[:, j] <= e).any() else nperm for j in range(bad)]

    def wrong(at: list[int]) -> float:
        going, out = np.zeros(bad + 1), 0.0
        going[0] = 1.0
        for n in range(1, nperm + 1):
            share = (bad - np.arange(bad + 1)) / (nperm - n + 1)
            hit = going * share
            going = going - hit
            going[1:] += hit[:-1]
            for j in range(bad):
                if n >= at[j]:
                    out, going[j] = out + going[j], 0.0
        return out

    low, high = 0.0, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if wrong(ends(mid)) <= eta else (low, mid)
    return tuple(ends(low)) if low > 0 else none


@dataclass(frozen=True)
class Settings:
    """Of segmentation. eta: 0 makes all permutations, more may end a test early (see stopping)."""

    alpha: float = 0.01
    nperm: int = 200
    min_width: int = 2
    hybrid: bool = False
    kmax: int = 25
    nmin: int = 200
    eta: float = 0.0


def trial(stat: float, i: int, j: int, n: int, given: Settings, w: np.ndarray | None = None) -> tuple[int, int | None] | bool:
    """What the largest arc of n values asks for: False, no change; True, one without a test; else how many permutations may reach it, and the longest arcs they look at."""
    if stat <= 0.01:
        return False
    if math.sqrt(stat) >= 7 and min(j - i, n - (j - i)) >= 10:
        return True
    limit, cut = int(given.alpha * given.nperm), None
    if given.hybrid and n > given.nmin:
        delta = (given.kmax + 1) / n if w is None else least_weights(np.concatenate([[0.0], np.cumsum(w)]), [given.kmax + 1])[0] / w.sum()
        p = tail(math.sqrt(stat), delta, n)
        if p > given.alpha:
            return False
        limit, cut = int((given.alpha - p) * given.nperm), given.kmax
    return limit, cut


def hit(x: np.ndarray, rng: np.random.Generator, stat: float, cut: int | None, min_width: int, w: np.ndarray | None = None) -> bool:
    """Whether a permutation of x reaches the statistic."""
    y = rng.permutation(x) if w is None else rng.permutation(x * np.sqrt(w)) / np.sqrt(w)
    if w is not None:
        y = y - (w * y).sum() / w.sum()
    return reaches(y, min_width, 0.99999 * stat, w, cut)


def confirmed(hits: Iterable[tuple[int, bool]], limit: int, given: Settings) -> bool | None:
    """Whether the test passes by the hits of permutations 0, 1, ... in order; None if they don't decide yet."""
    ends, n = stopping(given.nperm, limit, given.eta), 0
    for k, is_hit in hits:
        n += is_hit
        if n > limit:
            return False
        if k + 1 >= ends[n]:
            return True
    return None


def edges(x: np.ndarray, i: int, j: int, given: Settings, draw: Callable[[int], np.random.Generator], w: np.ndarray | None = None) -> list[int]:
    """The ends of an arc at which the means of what lies on either side differ."""
    n = len(x)
    if i == 0 or j == n:
        return [c for c in ([j] if i == 0 else [i]) if 0 < c < n]
    rng = draw(given.nperm)
    p = [permutation_p(x[a:c], x[c:e], given.nperm, rng) if w is None else weighted_permutation_p(x[a:c], x[c:e], w[a:c], w[c:e], given.nperm, rng) for a, c, e in ((0, i, j), (i, j, n))]
    return [c for c, v in zip((i, j), p, strict=True) if v <= given.alpha]


def change_points(x: np.ndarray, given: Settings, draw: Callable[[int], np.random.Generator], w: np.ndarray | None = None) -> list[int]:
    """0, 1 or 2 places where the mean of x changes. x must have (weighted) mean zero."""
    stat, i, j = largest_arc(x, given.min_width, w)
    asks = trial(stat, i, j, len(x), given, w)
    if isinstance(asks, tuple):
        limit, cut = asks
        asks = confirmed(((k, hit(x, draw(k), stat, cut, given.min_width, w)) for k in range(given.nperm)), limit, given) is not False
    return edges(x, i, j, given, draw, w) if asks else []


def varies(x: np.ndarray, min_width: int) -> bool:
    """Whether there is something to cut: values enough, and not all equal."""
    return len(x) >= 2 * min_width and x.max() - x.min() > 1e-12


def prune(x: np.ndarray, ends: list[int], cutoff: float = 0.05) -> list[int]:
    """The fewest of the segments' ends whose sum of squares is within a share `cutoff` of that with all.

    Leaving out the ends between two points adds an excess to the sum of squares, which grows with every further point;
    so from each point only those are tried up to which the excess stays within what may be added. By point and number
    of ends left out the least excess is kept: the exact optimum.
    """
    s, q = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    points, k = np.array([0, *ends]), len(ends)
    cost = lambda a, b: q[points[b]] - q[points[a]] - (s[points[b]] - s[points[a]]) ** 2 / (points[b] - points[a])
    upto = np.concatenate([[0.0], np.cumsum(np.maximum(cost(np.arange(k), np.arange(1, k + 1)), 0.0))])
    room = cutoff * upto[k] + 1e-12
    least, back = [np.zeros(1)], [np.zeros(1, np.int64)]
    for j in range(1, k + 1):
        best, by = least[j - 1].copy(), np.full(len(least[j - 1]), j - 1)
        for a in range(j - 2, -1, -1):
            excess, gone = float(cost(a, j) - (upto[j] - upto[a])), j - a - 1
            if excess > room:
                break
            new = least[a] + excess
            n = gone + int(np.count_nonzero(new <= room))  # the least excess grows with the number left out
            if n > len(best):
                best, by = np.append(best, np.full(n - len(best), math.inf)), np.append(by, np.full(n - len(by), -1))
            better = new[: n - gone] < best[gone:n]
            best[gone:n][better], by[gone:n][better] = new[: n - gone][better], a
        least.append(best)
        back.append(by)
    out, j, gone = [], k, len(least[k]) - 1
    while j:
        out.append(int(points[j]))
        a = int(back[j][gone])
        j, gone = a, gone - (j - a - 1)
    return out[::-1]


def segment(x: np.ndarray, alpha: float = 0.01, nperm: int = 200, min_width: int = 2, hybrid: bool = False, kmax: int = 25, nmin: int = 200, undo_prune: bool = False, seed: int = 1, w: np.ndarray | None = None, eta: float = 0.0) -> tuple[list[int], list[float]]:
    """Lengths and (weighted) means of the segments of x."""
    x, given = np.asarray(x, float), Settings(alpha, nperm, min_width, hybrid, kmax, nmin, eta)
    todo, ends = [(0, len(x))], []
    while todo:
        a, e = todo.pop()
        y, v = x[a:e], None if w is None else np.asarray(w, float)[a:e]
        found: list[int] = []
        if varies(y, min_width):
            mean = y.mean() if v is None else (v * y).sum() / v.sum()
            found = change_points(y - mean, given, draws(seed, a, e), v)
        if found:
            cut = [a, *(a + p for p in found), e]
            todo += [*zip(cut, cut[1:], strict=False)]
        else:
            ends.append(e)
    return lengths_and_means(x, sorted(ends), undo_prune, w)


def lengths_and_means(x: np.ndarray, ends: list[int], undo_prune: bool = False, w: np.ndarray | None = None) -> tuple[list[int], list[float]]:
    if undo_prune and len(ends) > 2:
        ends = prune(x, ends)
    at = [0, *ends]
    means = [float(x[a:b].mean() if w is None else np.average(x[a:b], weights=w[a:b])) for a, b in zip(at, at[1:], strict=False)]
    return [b - a for a, b in zip(at, at[1:], strict=False)], means


def deviations(given: DataFrame, trim: float = 0.025, width: int = scan.BIN) -> DataFrame:
    """(sample, sd): of each sample the root of trimmed_variance over its values, in order of chromosome and place.
    given: finite values, dealt by scan.deal.

    Differences are taken within chromosomes and between their ends, equal ones are counted, and they are ranked within
    cells of size, so no sample meets in one task.
    """
    place = F.struct("pos", "marker")
    inner = differences(given, ["sample", "chrom"], ["pos", "marker"], "value", width, dealt=True).select("sample", F.abs("diff").alias("a"))
    ends = given.groupBy("sample", "chrom").agg(F.min_by("value", place).alias("head"), F.max_by("value", place).alias("tail"))
    between = ends.select("sample", F.abs(F.col("head") - F.lag("tail").over(Window.partitionBy("sample").orderBy("chrom"))).alias("a"))
    d = trimmed_squares(inner.unionByName(between).filter("a is not null"), ["sample"], trim)
    return d.select("sample", F.sqrt("_variance").alias("sd"))


def _finite(raw: DataFrame) -> DataFrame:
    # A cast that changes nothing would stay as a new name in some branches of a plan, which then share no shuffle.
    value = F.col("value") if raw.schema["value"].dataType == DoubleType() else F.col("value").cast("double").alias("value")
    return raw.select("sample", "chrom", "pos", "marker", value).filter("value is not null and not isnan(value) and abs(value) < double('infinity')")


def smooth_raw(raw: DataFrame, scope: str = "sample", trim: float = 0.025, region: int = 10, rows: int = 100_000, width: int = scan.BIN, ties: str = "marker", **options) -> DataFrame:
    """raw with smoothed values; the deviation is that of the whole sample, or of each chromosome. ties: what orders values of one place.

    Values are smoothed in bins of `rows` values with `region` of their neighbours on either side; those that aren't
    finite stay as they are and are nobody's neighbours. The deviations and the smoothing scan the same dealt rows.
    """
    names, keys, order = ["sample", "marker", "chrom", "pos", "value"], ["sample", "chrom"], ["pos", ties]
    rest = raw.select(*names[:-1], F.col("value").cast("double").alias("value")).filter("value is null or isnan(value) or abs(value) = double('infinity')")
    given = scan.deal(_finite(raw), keys, order, width)
    if scope == "sample":
        sd = deviations(given, trim, width)
    else:
        sizes = differences(given, keys, order, "value", width, dealt=True).filter("diff is not null").select(*keys, F.abs("diff").alias("a"))
        sd = trimmed_squares(sizes, keys, trim).select(*keys, F.sqrt("_variance").alias("sd"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sd = pdf["sd"].fillna(0.0).iloc[0]  # none: a single value, which stays
        return pdf.assign(value=smooth(pdf["value"].to_numpy(), region=region, trim=trim, sd=float(sd), **options))[names]

    out = scan.by_halo(given, keys, order, region, run, rest.schema, rows, width, dealt=True, of_key=sd)
    return out.unionByName(rest)
