"""Gradient-boosted trees on feature tables, flattened into node arrays for vectorised scoring.

``fit`` takes arrays; ``fit_rows`` takes a table of any size, whose tasks total the derivatives per node,
feature and bin, so that the driver holds these totals alone. Scoring walks all trees of a batch level by
level. Features named in ``monotone`` (+1 or -1) never move the score the other way: a split that would is
refused, and the middle of its two values bounds both branches below it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

CELL_BITS = 42  # low bits of a double that its cell leaves out: 1024 cells for each factor of 2
SCALE = 1 << 30  # derivatives are totalled as whole numbers of this part, so totals agree in any order
PIECE_ROWS = 50_000  # rows a task of a fit counts


@dataclass
class Trees:
    """Complete binary trees of one depth: node ``i`` has children ``2i+1`` and ``2i+2``; leaves hold values."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; a value above it goes right
    leaf: np.ndarray  # trees x leaves
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: Mapping[int, int] | None = None,
    rounds: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 48,
    ridge: float = 2.0,
    least: float = 2.0,
) -> Trees:
    """Logistic boosting on quantile bins; ``least`` is the smallest sum of second derivatives of a leaf."""
    monotone = dict(monotone or {})
    n, width = x.shape
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
    margin = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features, edges, values = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    span = bins + 1
    shift = np.arange(width) * span
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        low, high = np.full(2**(depth + 1) - 1, -np.inf), np.full(2**(depth + 1) - 1, np.inf)
        for level in range(depth):
            first, width_now = 2**level - 1, 2**level
            slot = ((at - first)[:, None] * (width * span) + shift + binned).ravel()
            size = width_now * width * span
            g = np.bincount(slot, np.repeat(grad, width), size).reshape(width_now, width, span)
            h = np.bincount(slot, np.repeat(hess, width), size).reshape(width_now, width, span)
            gl, hl = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
            gt, ht = g.sum(axis=2, keepdims=True), h.sum(axis=2, keepdims=True)
            gr, hr = gt - gl, ht - hl
            lo, hi = low[first : first + width_now, None, None], high[first : first + width_now, None, None]
            vl, vr = np.clip(gl / (hl + ridge), lo, hi), np.clip(gr / (hr + ridge), lo, hi)
            v0 = np.clip(gt / (ht + ridge), lo, hi)
            worth = lambda v, gg, hh: 2 * v * gg - v * v * (hh + ridge)
            gain = worth(vl, gl, hl) + worth(vr, gr, hr) - worth(v0, gt, ht)
            gain[(hl < least) | (hr < least)] = -np.inf
            for f, sign in monotone.items():
                gain[:, f][sign * (vr[:, f] - vl[:, f]) < 0] = -np.inf
            flat = gain.reshape(width_now, -1)
            best = flat.argmax(axis=1)
            for i in range(width_now):
                node, f, b = first + i, best[i] // (span - 1), best[i] % (span - 1)
                left, right = 2 * node + 1, 2 * node + 2
                low[left] = low[right] = low[node]
                high[left] = high[right] = high[node]
                if flat[i, best[i]] > 1e-9 and b < len(cuts[f]):
                    features[r, node], edges[r, node] = f, cuts[f][b]
                    if monotone.get(f):
                        middle = (vl[i, f, b] + vr[i, f, b]) / 2
                        if monotone[f] > 0:
                            high[left] = low[right] = middle
                        else:
                            low[left] = high[right] = middle
            at = 2 * at + 1 + (x[np.arange(n), features[r][at]] > edges[r][at])
        place = at - inner
        g, h = np.bincount(place, grad, leaves), np.bincount(place, hess, leaves)
        values[r] = rate * np.clip(g / (h + ridge), low[inner:], high[inner:])
        margin += values[r][place]
    return Trees(features, edges, values, base, depth)


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8)
            yield raw.reshape(-1, width), batch.column(1).to_numpy()


def cells(x: np.ndarray) -> np.ndarray:
    """Whole numbers that never decrease as the values, none below zero, grow."""
    return np.ascontiguousarray(x, np.float64).view(np.int64) >> CELL_BITS


def bin_edges(rows: DataFrame, features: str, width: int, bins: int) -> list[np.ndarray]:
    """Upper edges of about equally full bins per feature, from the counts of all rows per cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = cells(batch.column(0).flatten().to_numpy()).reshape(-1, width)
            for f in range(width):
                cell, n = np.unique(x[:, f], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), f)), pa.array(cell), pa.array(n)], names=["f", "cell", "n"])

    found = rows.select(features).mapInArrow(count, "f long, cell long, n long").groupBy("f", "cell").agg(F.sum("n").alias("n")).toArrow()
    f, cell, n = (found.column(i).to_numpy() for i in range(3))
    cuts = []
    for i in range(width):
        own = np.flatnonzero(f == i)
        own = own[np.argsort(cell[own])]
        up_to = np.cumsum(n[own])
        wanted = np.searchsorted(up_to, np.ceil(np.arange(1, bins) * up_to[-1] / bins))
        cuts.append((((np.unique(cell[own][wanted]) + 1) << CELL_BITS) - 1).view(np.float64))
    return cuts


def fit_rows(
    rows: DataFrame,
    features: str,
    label: str,
    n: int,
    positive: int,
    monotone: Mapping[int, int],
    width: int,
    rounds: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 48,
    ridge: float = 2.0,
    least: float = 2.0,
) -> Trees:
    """``fit`` over all ``n`` rows of a table with ``positive`` labels 1; features are arrays of numbers not below zero.

    One job per level of a tree: a task finds the rows' margins from the trees so far and totals the derivatives.
    """
    share = min(max(positive / n, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    cuts = bin_edges(rows, features, width, bins)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, width)
            binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in binned], pa.binary()), batch.column(1).cast(pa.float64())], names=["bins", "y"])

    table = stored(rows.select(features, label).mapInArrow(to_bins, "bins binary, y double").coalesce(n // PIECE_ROWS + 1))
    inner, span = 2**depth - 1, bins + 1
    chosen, edge_bins = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), 255)
    edges, values = np.full((rounds, inner), np.inf), np.zeros((rounds, 2**depth))

    def totals(r: int, level: int) -> np.ndarray:
        first, nodes = 2**level - 1, 2**level
        trees = (chosen[: r + 1].copy(), edge_bins[: r + 1].copy(), values[:r].copy())

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            picked, limits, leaves = trees
            total = np.zeros((2, width, nodes * span), np.int64)
            for b, y in _batches(batches, width):
                at_row = np.arange(len(b))

                def walk(t: int, levels: int) -> np.ndarray:
                    at = np.zeros(len(b), np.int64)
                    for _ in range(levels):
                        at = 2 * at + 1 + (b[at_row, picked[t][at]] > limits[t][at])
                    return at

                margin = np.full(len(b), base)
                for t in range(r):
                    margin += leaves[t][walk(t, depth) - inner]
                p = 1 / (1 + np.exp(-margin))
                slot = (walk(r, level) - first) * span
                for i, d in enumerate((np.rint((y - p) * SCALE), np.rint(p * (1 - p) * SCALE))):
                    for f in range(width):
                        total[i, f] += np.bincount(slot + b[:, f], d, nodes * span).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        parts = [np.frombuffer(x.total, np.int64) for x in table.mapInArrow(count, "total binary").collect()]
        return np.sum(parts, axis=0).reshape(2, width, nodes, span).transpose(0, 2, 1, 3) / SCALE

    for r in range(rounds):
        low, high = np.full(2 ** (depth + 1) - 1, -np.inf), np.full(2 ** (depth + 1) - 1, np.inf)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            g, h = totals(r, level)
            gl, hl = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
            gt, ht = g.sum(axis=2, keepdims=True), h.sum(axis=2, keepdims=True)
            gr, hr = gt - gl, ht - hl
            lo, hi = low[first : first + nodes, None, None], high[first : first + nodes, None, None]
            best_of = lambda gg, hh: np.clip(gg / (hh + ridge), lo, hi)
            worth = lambda v, gg, hh: 2 * v * gg - v * v * (hh + ridge)
            vl, vr, v0 = best_of(gl, hl), best_of(gr, hr), best_of(gt, ht)
            gain = worth(vl, gl, hl) + worth(vr, gr, hr) - worth(v0, gt, ht)
            gain[(hl < least) | (hr < least)] = -np.inf
            for f, sign in monotone.items():
                gain[:, f][sign * (vr[:, f] - vl[:, f]) < 0] = -np.inf
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for i in range(nodes):
                node, f, b = first + i, best[i] // (span - 1), best[i] % (span - 1)
                left, right = 2 * node + 1, 2 * node + 2
                low[left] = low[right] = low[node]
                high[left] = high[right] = high[node]
                split = gain[i, f, b] > 1e-9 and b < len(cuts[f])
                if split:
                    chosen[r, node], edge_bins[r, node], edges[r, node] = f, b, cuts[f][b]
                    if monotone.get(f):
                        middle = (vl[i, f, b] + vr[i, f, b]) / 2
                        if monotone[f] > 0:
                            high[left] = low[right] = middle
                        else:
                            low[left] = high[right] = middle
                if level == depth - 1:  # a node without a split sends all its rows left
                    ends = ((gl[i, f, b], hl[i, f, b]), (gr[i, f, b], hr[i, f, b])) if split else ((gt[i, 0, 0], ht[i, 0, 0]), (0.0, 0.0))
                    for child, (gg, hh) in zip((left, right), ends, strict=True):
                        values[r, child - inner] = rate * np.clip(gg / (hh + ridge), low[child], high[child])
    return Trees(chosen, edges, values, base, depth)
