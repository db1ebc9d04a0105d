"""A random forest as arrays: grown tree by tree in tasks, applied to whole batches of rows.

Features are coded once by the thresholds between their bins; a tree is grown level by level from counts per
(node, tried feature, bin, class).  Method and parameters are those of MLlib's forest (midpoints of evenly filled bins,
Poisson bootstrap, Gini gain of class-weighted counts, a random feature subset per node, like sibling leaves merged);
the random draws are not.  Equal rows give equal forests, in whatever order and number of partitions they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LEAST_GAIN = 1e-12  # below this share of a node's weight a gain is rounding
LEAF = 0xFFFF  # in the place of a node's bin, above every code
TREE_SCHEMA = "tree int, nodes binary, benign binary"
SLICE = 4096  # nodes whose counts are held at once


@dataclass
class Forest:
    """``nodes`` of a tree: first child, feature and bin in one word each (a leaf leads to itself); ``benign``: a node's share of benign weight."""

    features: list[str]
    thresholds: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray]]


def words(left: np.ndarray, feature: np.ndarray, split: np.ndarray) -> np.ndarray:
    return left.astype(np.int64) << 32 | feature.astype(np.int64) << 16 | split.astype(np.int64)


def cut_points(values: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 thresholds: midpoints of neighbouring values, at about equal weight between them."""
    distinct, place = np.unique(values, return_inverse=True)
    middle = distinct[:-1] / 2 + distinct[1:] / 2
    if len(distinct) <= bins:
        return middle
    upto = np.cumsum(np.bincount(place, weights=weight))
    cuts, stride = [], upto[-1] / bins
    target, i = stride, 1
    while i < len(distinct):
        i = max(i, int(np.searchsorted(upto, target)))  # below it every value comes nearer to the target
        if i < len(distinct) and abs(upto[i - 1] - target) < abs(upto[i] - target):
            cuts.append(i - 1)
            target += stride
        i += 1
    return np.unique(middle[cuts])


def coded(values: list[np.ndarray], thresholds: list[np.ndarray]) -> np.ndarray:
    """A row of codes per feature: how many thresholds lie below the value, so a code of at most b means a value of at most threshold b."""
    kind = np.uint8 if max(map(len, thresholds)) < 256 else np.uint16
    return np.stack([np.searchsorted(t, v).astype(kind) for v, t in zip(values, thresholds, strict=True)])


def in_order(codes: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by value, so that draws by position do not depend on how they were gathered."""
    order = np.lexsort([target, *codes])
    return np.ascontiguousarray(codes[:, order]), target[order]


def gini(benign: np.ndarray, threat: np.ndarray) -> np.ndarray:
    """Impurity times weight."""
    return 2 * benign * threat / np.maximum(benign + threat, np.finfo(float).tiny)


def best_splits(counts: np.ndarray, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From counts (node, feature, bin, class): the feature's place and the bin of each node's best split, -1 where none gains; counts of its left side."""
    left = counts.cumsum(axis=2)
    whole = left[:, 0, -1]
    left = left[:, :, :-1]
    b, t = left[..., 0] * weights[0], left[..., 1] * weights[1]
    wb, wt = (whole * weights).T
    rb, rt = (whole[:, None, None, 0] - left[..., 0]) * weights[0], (whole[:, None, None, 1] - left[..., 1]) * weights[1]
    gain = gini(wb, wt)[:, None, None] - gini(b, t) - gini(rb, rt)
    gain[(b + t == 0) | (rb + rt == 0)] = -1.0
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    every = np.arange(len(best))
    feature, split = np.divmod(best, gain.shape[2])
    feature[flat[every, best] <= LEAST_GAIN * (wb + wt)] = -1
    return feature, split, left[every, feature, split]


def grown(codes: np.ndarray, target: np.ndarray, weights: tuple[float, float], bins: int, depth: int, tried: int,
          rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One tree: words of its nodes and their shares of benign weight."""
    n_features, n = codes.shape
    drawn = rng.poisson(1.0, n)
    while not drawn.any():
        drawn = rng.poisson(1.0, n)
    rows = np.flatnonzero(drawn)
    drawn, y, flat = drawn[rows].astype(float), target[rows].astype(np.int64), codes.reshape(-1)
    counts = [np.bincount(y, weights=drawn, minlength=2)[None]]  # a level's nodes at a time
    parts, size = [], 1  # of a level: its nodes that are split, their features, bins and first children
    nodes, place = np.flatnonzero((counts[0] > 0).all(axis=1)), np.zeros(len(rows), dtype=np.int64)  # open nodes; of each row its open node's position
    for level in range(depth):
        if not len(nodes):
            break
        subset = np.argsort(rng.random((len(nodes), n_features)), axis=1)[:, :tried]
        feature, split = np.empty(len(nodes), dtype=np.int64), np.empty(len(nodes), dtype=np.int64)
        left = np.empty((len(nodes), 2))
        for start in range(0, len(nodes), SLICE):
            end = min(start + SLICE, len(nodes))
            own = slice(None) if end - start == len(nodes) else np.flatnonzero((place >= start) & (place < end))
            at, here, double = place[own] - start, rows[own], y[own]
            times, k = drawn[own], end - start
            found = np.empty((k, tried, bins, 2))
            for j in range(tried):
                code = flat.take(subset[start:end, j].take(at) * n + here)
                found[:, j] = np.bincount((at * bins + code) * 2 + double, weights=times, minlength=k * bins * 2).reshape(k, bins, 2)
            chosen, split[start:end], left[start:end] = best_splits(found, weights)
            feature[start:end] = np.where(chosen < 0, -1, subset[np.arange(start, end), chosen])
        is_split = feature >= 0
        if not is_split.any():
            break
        whole = counts[-1][nodes - (size - len(counts[-1]))]
        children = np.stack([left, whole - left], axis=1)[is_split].reshape(-1, 2)
        parts.append((nodes[is_split], feature[is_split], split[is_split], size + 2 * np.arange(is_split.sum())))
        is_open = (children > 0).all(axis=1) & (level + 1 < depth)
        kept = is_split.take(place)
        rows, y, drawn, place = rows[kept], y[kept], drawn[kept], place[kept]
        child = 2 * (np.cumsum(is_split) - 1).take(place) + (flat.take(feature.take(place) * n + rows) > split.take(place))
        kept = is_open.take(child)
        rows, y, drawn, place = rows[kept], y[kept], drawn[kept], (np.cumsum(is_open) - 1).take(child[kept])
        nodes = size + np.flatnonzero(is_open)
        size += len(children)
        counts.append(children)
    return merged(np.concatenate(counts) * weights, parts)


def merged(weight: np.ndarray, parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """The tree without sibling leaves of one class, from the lowest level up."""
    size = len(weight)
    threat = weight[:, 1] > weight[:, 0]
    left, feature, split = np.full(size, -1), np.zeros(size, dtype=np.int64), np.full(size, LEAF)
    for nodes, features, splits, first in reversed(parts):
        like = (left[first] < 0) & (left[first + 1] < 0) & (threat[first] == threat[first + 1])
        at = nodes[~like]
        left[at], feature[at], split[at] = first[~like], features[~like], splits[~like]
    kept = np.zeros(size, dtype=bool)
    kept[0] = True
    for nodes, _, _, first in parts:
        down = first[kept[nodes] & (left[nodes] >= 0)]
        kept[down] = kept[down + 1] = True
    number = np.cumsum(kept) - 1
    is_leaf = left < 0
    left = np.where(is_leaf, number, number[left])[kept]
    return words(left, feature[kept], split[kept]), (weight[:, 0] / weight.sum(axis=1))[kept]


def shares(codes: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Mean share of benign weight over the trees, for rows of codes."""
    n, n_features = codes.shape
    flat, base, total = codes.astype(np.int64).reshape(-1), np.arange(n, dtype=np.int64) * n_features, np.zeros(n)
    for nodes, benign in trees:
        row, at, node = np.arange(n), base, np.zeros(n, dtype=np.int64)
        while len(node):
            for _ in range(4):  # a leaf leads to itself
                word = nodes.take(node, mode="wrap")
                node = (word >> 32) + (flat.take(at + (word >> 16 & 0xFFFF), mode="wrap") > (word & 0xFFFF))
            going = np.flatnonzero((nodes.take(node, mode="wrap") & 0xFFFF) != LEAF)
            if len(going) <= 0.75 * len(node):
                share = benign.take(node, mode="wrap")
                share[going] = 0.0
                total[row] += share
                row, at, node = row[going], at[going], node[going]
    return total / len(trees)


def batch(number: int, tree: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([number], pa.int32()), pa.array([tree[0].tobytes()], pa.binary()), pa.array([tree[1].tobytes()], pa.binary())], ["tree", "nodes", "benign"])


def trees_of(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    found = sorted(zip(*(table[c].to_pylist() for c in ("tree", "nodes", "benign")), strict=True))
    return [(np.frombuffer(nodes, np.int64), np.frombuffer(benign, np.float64)) for _, nodes, benign in found]


def from_mllib(features: list[str], found: pa.Table) -> Forest:
    """A forest from MLlib's stored nodes (tree, benign, threat, left, right, feature, threshold), ordered by tree and number."""
    column = {c: found[c].to_numpy() for c in found.column_names}
    inner = column["left"] >= 0
    cuts = [np.unique(column["threshold"][inner & (column["feature"] == i)]) for i in range(len(features))]
    trees = []
    for own in np.split(np.arange(len(inner)), np.flatnonzero(np.diff(column["tree"])) + 1):
        levels = [own[:1]]
        while len(levels[-1]):
            parents = levels[-1][inner[levels[-1]]]
            levels.append(own[0] + np.stack([column["left"][parents], column["right"][parents]], axis=1).reshape(-1))
        order = np.concatenate(levels)  # children side by side
        left, feature, split = np.arange(len(order)), np.maximum(column["feature"][order], 0), np.full(len(order), LEAF)
        at = np.flatnonzero(inner[order])
        left[at] = 1 + 2 * np.arange(len(at))
        split[at] = [np.searchsorted(cuts[f], t) for f, t in zip(feature[at], column["threshold"][order[at]], strict=True)]
        benign, threat = column["benign"][order], column["threat"][order]
        trees.append((words(left, feature, split), benign / (benign + threat)))
    return Forest(features, cuts, trees)


def grown_batches(data, weights: tuple[float, float], bins: int, depth: int, tried: int, seed: int):
    """A task that grows the trees of its numbers from broadcast codes and targets."""
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, target = data.value
        for numbers in batches:
            for number in numbers.column(0).to_pylist():
                yield batch(number, grown(codes, target, weights, bins, depth, tried, np.random.default_rng([seed, number])))

    return grow
