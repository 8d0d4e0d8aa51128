"""The best of the segments that overlap a target, found without its pairs with them.

Of a sample's segments with one score only those matter that lie in no other: by start their ends ascend, too, so those
that overlap a target are a range of them. Of a range that is long, a few candidates suffice (see Edge.cover).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd

CHUNK = 1_000_000  # (target, sample) pairs, or candidates, that are looked at together


class Rule(NamedTuple):
    """Which segment is best: that of the most extreme score (a loss before a gain) among those that cover more than
    `gain` of the target's exons (losses: `loss`), or, relaxed, overlap it; greatest: the one that covers most above
    these, a loss before a gain."""

    relaxed: bool = False
    greatest: bool = False
    gain: float = -2.0
    loss: float = -2.0


def within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of so many parts each: the parts' rows, and their numbers in the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


class Targets:
    """Targets' intervals and exons (flat, by target), from 0 at `base`. A target's exons are plain if they are in order
    and apart; without exons, or with unknown ends, its share is unknown (-1)."""

    def __init__(self, pdf: pd.DataFrame, base: int, exons: bool):
        self.start, self.end = pdf["_s"].to_numpy(np.int64) - base, pdf["_e"].to_numpy(np.int64) - base
        if not exons:
            return
        none = np.zeros(0)
        pairs = [(none, none) if a is None or b is None or pd.isna(a).any() or pd.isna(b).any() else (a, b) for a, b in zip(pdf["_xs"], pdf["_xe"], strict=True)]
        self.n = np.array([len(a) for a, _ in pairs], np.int64)
        self.at = np.cumsum(self.n) - self.n
        self.xs, self.xe = (np.concatenate([none, *x]).astype(np.int64) - base for x in zip(*pairs, strict=True))
        owner, place = within(self.n)
        size = self.xe - self.xs + 1
        self.total = np.bincount(owner, size, len(pdf))
        odd = (size <= 0) | ((place > 0) & (self.xs <= np.append(0, self.xe[:-1])))
        self.plain = np.bincount(owner, odd, len(pdf)) == 0
        # Pairs of exons (the first not behind the second), of plain targets.
        k = np.where(self.plain, self.n, 0)
        self.pairs = k * (k + 1) // 2
        self.pair_at = np.cumsum(self.pairs) - self.pairs
        first = np.repeat(self.xs, np.where(self.plain[owner], self.n[owner] - place, 0))
        _, behind = within(np.where(self.plain[owner], self.n[owner] - place, 0))
        second = np.repeat(np.arange(len(owner)), np.where(self.plain[owner], self.n[owner] - place, 0)) + behind
        self.pair_from, self.pair_to = first, self.xe[second]


class Edge:
    """The segments of each sample that lie in no other of the sample, one sample after the other, `span` apart."""

    def __init__(self, code: np.ndarray, start: np.ndarray, end: np.ndarray, span: int):
        s, e = code * span + start, code * span + end
        order = np.lexsort((-e, s))
        s, e = s[order], e[order]
        top = np.maximum.accumulate(e)
        keep = np.append(True, e[1:] > top[:-1])
        self.s, self.e, self.span = s[keep], e[keep], span
        self.table: list[np.ndarray] = []

    def ranges(self, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.e, code * self.span + start, "left"), np.searchsorted(self.s, code * self.span + end, "right")

    def longest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of each range (not empty) the longest segment, from a table of those of ranges of powers of two."""
        size = self.e - self.s
        if not self.table:
            self.table = [np.arange(len(size))]
            while (w := 1 << len(self.table)) <= len(size):
                a, b = self.table[-1][: len(size) - w + 1], self.table[-1][w // 2 : len(size) - w // 2 + 1]
                self.table.append(np.where(size[b] > size[a], b, a))
        out = np.empty(len(lo), np.int64)
        level = np.frexp((hi - lo).astype(float))[1] - 1
        for k in np.unique(level):
            m = level == k
            a, b = self.table[k][lo[m]], self.table[k][hi[m] - (1 << int(k))]
            out[m] = np.where(size[b] > size[a], b, a)
        return out

    def covered(self, t: Targets, target: np.ndarray, code: np.ndarray, seg: np.ndarray) -> np.ndarray:
        """How many positions of each target's exons (one at least) a segment covers."""
        out = np.zeros(len(target), np.int64)
        s, e = self.s[seg] - code * self.span, self.e[seg] - code * self.span
        n, at = t.n[target], t.at[target]
        for k in range(int(n.max(initial=0))):
            m = slice(None) if (n > k).all() else np.flatnonzero(n > k)
            x = at[m] + k
            out[m] += np.maximum(np.minimum(e[m], t.xe[x]) - np.maximum(s[m], t.xs[x]) + 1, 0)
        return out

    def cover(self, t: Targets, target: np.ndarray, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The most positions of each target's exons that a segment of its range lo..hi covers.

        Where the range is long: a segment that begins outside of exons, or at an exon's begin, covers no more than the
        last one to begin at or before the next exon's begin; one that ends outside, or at an exon's end, no more than
        the first to end at or behind the last exon's end before that. Of those that begin in an exon and end in one,
        the longest between that one's begin and that one's end covers as much: at most the gaps between are lost to it.
        """
        best = np.zeros(len(target), np.int64)
        few = ~t.plain[target] | (hi - lo <= 2 * t.n[target] + t.pairs[target])
        rows = np.flatnonzero(few)
        ends = np.cumsum((hi - lo)[rows])
        for part in np.split(rows, np.searchsorted(ends, np.arange(CHUNK, int(ends[-1]) if len(ends) else 0, CHUNK))):
            r, k = within((hi - lo)[part])
            r = part[r]
            self._most(best, t, target, code, r, lo[r] + k)
        rows = np.flatnonzero(~few)
        if len(rows):
            r, k = within(t.n[target[rows]])
            r = rows[r]
            x, shift = t.at[target[r]] + k, code[r] * self.span
            self._most(best, t, target, code, r, np.clip(np.searchsorted(self.s, t.xs[x] + shift, "right") - 1, lo[r], hi[r] - 1))
            self._most(best, t, target, code, r, np.clip(np.searchsorted(self.e, t.xe[x] + shift, "left"), lo[r], hi[r] - 1))
            r, k = within(t.pairs[target[rows]])
            r = rows[r]
            x, shift = t.pair_at[target[r]] + k, code[r] * self.span
            a, b = np.searchsorted(self.s, t.pair_from[x] + shift, "left"), np.searchsorted(self.e, t.pair_to[x] + shift, "right")
            some = a < b
            self._most(best, t, target, code, r[some], self.longest(a[some], b[some]))
        return best

    def _most(self, best: np.ndarray, t: Targets, target: np.ndarray, code: np.ndarray, row: np.ndarray, seg: np.ndarray) -> None:
        np.maximum.at(best, row, self.covered(t, target[row], code[row], seg))


def best_scores(key: list[str], rule: Rule) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """best_parts in one."""
    return lambda targets, segments: pd.concat(best_parts(key, rule)(targets, segments), ignore_index=True)


def best_parts(key: list[str], rule: Rule) -> Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]]:
    """For intervals.at_home: (key, sample, score, _share) of targets (key, _xs and _xe: exons' starts and ends) and
    segments (sample, score), of each target and sample the best segment by the rule, if there is one. _share is the
    share of the exons that it covers (greatest only; -1: unknown). A part is of CHUNK targets and samples at most."""

    def run(targets: pd.DataFrame, segments: pd.DataFrame) -> Iterator[pd.DataFrame]:
        base = int(min(targets["_s"].min(), segments["_s"].min(), segments["_e"].min(), targets["_e"].min()))
        t = Targets(targets, base, not rule.relaxed)
        start, end = segments["_s"].to_numpy(np.int64) - base, segments["_e"].to_numpy(np.int64) - base
        code, names = pd.factorize(segments["sample"], use_na_sentinel=False)
        score = segments["score"].to_numpy()
        span = int(max(end.max(), start.max(), t.end.max(), t.start.max(), 0 if rule.relaxed else max(t.xe.max(initial=0), t.xs.max(initial=0)))) + 2
        shift = 0
        if not rule.relaxed and len(t.xs) and (least := int(min(t.xs.min(), t.xe.min()))) < 0:
            # Exons that begin before all else: everything moves up, so that samples stay apart.
            shift = -least
            t.start, t.end, t.xs, t.xe, t.pair_from, t.pair_to = (x + shift for x in (t.start, t.end, t.xs, t.xe, t.pair_from, t.pair_to))
            span += shift
        values = sorted(set(score.tolist()), key=(lambda x: x) if rule.greatest else (lambda x: (-abs(x), x)))
        edges = []
        for v in values:
            m = score == v
            edges.append(Edge(code[m], start[m] + shift, end[m] + shift, span))
        names, given = np.asarray(names, object), {k: targets[k].to_numpy() for k in key}
        step = max(1, CHUNK // len(names))
        for begin in range(0, len(targets), step):
            n = min(step, len(targets) - begin)
            target, sample = np.repeat(np.arange(begin, begin + n), len(names)), np.tile(np.arange(len(names)), n)
            found, share = np.zeros(len(target), np.int64), np.full(len(target), -2.0)
            open_ = np.arange(len(target))
            for v, edge in zip(values, edges, strict=True):
                lo, hi = edge.ranges(t.start[target[open_]], t.end[target[open_]], sample[open_])
                hit = lo < hi
                rows, lo, hi = open_[hit], lo[hit], hi[hit]
                if rule.relaxed:
                    met = rows
                    share[met] = 0.0
                else:
                    got = np.full(len(rows), -1.0)
                    known = np.flatnonzero(t.total[target[rows]] > 0)
                    got[known] = edge.cover(t, target[rows[known]], sample[rows[known]], lo[known], hi[known]) / t.total[target[rows[known]]]
                    passes = (got > (rule.gain if v > 0 else rule.loss)) & (got > share[rows])
                    met = rows[passes]
                    share[met] = got[passes]
                found[met] = v
                done = share >= 1.0 if rule.greatest else share > -2.0
                open_ = open_[~done[open_]]
            yes = np.flatnonzero(share > -2.0)
            yield pd.DataFrame({k: v[target[yes]] for k, v in given.items()} | {"sample": names[sample[yes]], "score": found[yes].astype(np.int32), "_share": share[yes]})

    return run


def best_in_regions(key: list[str], rule: Rule) -> Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]]:
    """For intervals.at_home: best_parts for each pair of a region (key) and a gene that overlap, its target being the
    places that both hold. The other side has genes (_gene true: gene) and segments (sample, score). CHUNK pairs at most
    (of one region, if that has more) are laid out together, and only the parts of their scores."""
    score = best_parts([*key, "gene"], rule)

    def run(regions: pd.DataFrame, others: pd.DataFrame) -> Iterator[pd.DataFrame]:
        genes, segments = others[others["_gene"]], others[~others["_gene"]]
        if not len(genes) or not len(segments):
            return
        segments = segments.assign(score=segments["score"].astype(np.int64))
        (s, e), (gs, ge) = ((x["_s"].to_numpy(np.int64), x["_e"].to_numpy(np.int64)) for x in (regions, genes))
        step = max(1, CHUNK // len(genes))
        for begin in range(0, len(regions), step):
            part = slice(begin, begin + step)
            r, g = np.nonzero((s[part, None] <= ge) & (e[part, None] >= gs))
            if len(r):
                r += begin
                targets = pd.DataFrame({k: regions[k].to_numpy()[r] for k in key} | {"gene": genes["gene"].to_numpy()[g], "_s": np.maximum(s[r], gs[g]), "_e": np.minimum(e[r], ge[g])})
                yield from score(targets, segments)

    return run


def first_to_start(key: list[str], values: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]]:
    """For intervals.at_home: (key, sample, values) of points and segments (sample, values), of each point and sample the
    covering segment that starts, then ends, first."""

    def run(points: pd.DataFrame, segments: pd.DataFrame) -> Iterator[pd.DataFrame]:
        base = int(min(points["_s"].min(), segments["_s"].min(), segments["_e"].min()))
        at = points["_s"].to_numpy(np.int64) - base
        start, end = segments["_s"].to_numpy(np.int64) - base, segments["_e"].to_numpy(np.int64) - base
        code, names = pd.factorize(segments["sample"], use_na_sentinel=False)
        span = int(max(at.max(), start.max(), end.max())) + 2
        edge = Edge(code, start, end, span)
        starts, number = np.unique(code * span + start, return_inverse=True)
        order = np.argsort(number * span + end, kind="stable")
        ends = (number * span + end)[order]
        step = max(1, CHUNK // len(names))
        for begin in range(0, len(at), step):
            n = min(step, len(at) - begin)
            point, sample = np.repeat(np.arange(begin, begin + n), len(names)), np.tile(np.arange(len(names)), n)
            lo, hi = edge.ranges(at[point], at[point], sample)
            hit = lo < hi
            # Of those that cover a point the first to start lies in no other, or begins where such a one does.
            first = np.searchsorted(starts, edge.s[lo[hit]])
            met, seg = point[hit], order[np.searchsorted(ends, first * span + at[point[hit]])]
            out = {k: points[k].to_numpy()[met] for k in key} | {"sample": segments["sample"].to_numpy()[seg]}
            yield pd.DataFrame(out | {v: segments[v].to_numpy()[seg] for v in values})

    return run
