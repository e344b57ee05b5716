"""Decision trees on every row of a table, with every threshold between two values.

As in the reference's library, features count as 32-bit floats, a tree draws as
many rows as there are, with replacement, and a node splits at the best of all
thresholds of a few random features (of further ones while none of them can
split it), down to pure leaves. Trees grow level by level, several side by
side: a row's node, value, weight and class are packed into one integer, so
that one sort of integers puts all values of a level in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

VALUE_BITS = 32


@dataclass
class Nodes:
    """Nodes of some trees, each tree's in one piece that begins with its root."""

    tree: np.ndarray
    feature: np.ndarray        # -1 for a leaf
    threshold: np.ndarray      # rows up to it go left
    left: np.ndarray           # numbers inside the tree, -1 for a leaf
    right: np.ndarray
    gain: np.ndarray           # impurity decrease
    stats: np.ndarray          # (nodes, classes): weight of each class


def codes(x: np.ndarray) -> np.ndarray:
    """32-bit integers in the order of the values, as 32-bit floats."""
    if np.isnan(x).any():
        raise ValueError("features must not be null or NaN")
    with np.errstate(over="ignore"):
        bits = (x.astype(np.float32) + np.float32(0)).view(np.uint32)      # -0.0 becomes 0.0
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def values(code: np.ndarray) -> np.ndarray:
    bits = np.where(code >> 31, code ^ np.uint32(1 << 31), ~code)
    return bits.astype(np.uint32).view(np.float32).astype(float)


def between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Thresholds that part the values of neighbouring codes."""
    a, b = values(low), values(high)
    with np.errstate(invalid="ignore"):
        middle = a / 2 + b / 2
    return np.where(np.isfinite(middle) & (middle < b), middle, a)


def grow(code: np.ndarray, label: np.ndarray, class_weight: np.ndarray, trees: list[int], seed: int,
         max_depth: int, picks: int) -> Nodes:
    """The trees with the numbers ``trees``, side by side, of rows with feature ``code`` (features, rows) and ``label``."""
    features, n = code.shape
    classes = len(class_weight)
    flat = code.reshape(-1)
    drawn = [_drawn(n, seed, t) for t in trees]
    row = np.concatenate([r for r, _ in drawn])
    at = np.repeat(np.arange(len(trees)), [len(r) for r, _ in drawn])
    weight = np.concatenate([w for _, w in drawn])
    del drawn
    class_bits, weight_bits = max(1, (classes - 1).bit_length()), int(weight.max()).bit_length()
    low_bits = np.uint64(class_bits + weight_bits)
    packed = label[row].astype(np.uint64) << np.uint64(weight_bits) | weight.astype(np.uint64)
    total = np.bincount(at * classes + label[row], weight, len(trees) * classes).reshape(-1, classes).T
    del weight
    rng = np.random.default_rng([seed, *trees[:1], len(trees)])

    ids, made = np.arange(len(trees)), len(trees)
    tree = np.array(trees)
    out = [(ids, tree, total)]                 # all nodes; below, those that are split
    splits = []
    mixed = np.count_nonzero(total, axis=0) > 1
    keep = mixed[at]
    number = np.cumsum(mixed) - 1
    row, packed, at = row[keep], packed[keep], number[at[keep]]
    ids, tree, total = ids[mixed], tree[mixed], total[:, mixed]

    for _ in range(max_depth):
        m = len(ids)
        if not m:
            break
        if m.bit_length() + VALUE_BITS + int(low_bits) > 64:
            raise ValueError("too many nodes at a time")
        order = rng.random((m, features)).argsort(axis=1)
        best = np.full(m, -np.inf)
        feature = np.full(m, -1)
        below, above = np.zeros(m, np.uint32), np.zeros(m, np.uint32)
        to_left = np.zeros((classes, m))
        for k in range(features):
            some = None
            if k >= picks:                     # nodes whose features so far have one value each
                some = feature < 0
                if not some.any():
                    break
            _best_thresholds(flat, n, order[:, k], row, at, packed, some, low_bits, weight_bits, total, class_weight,
                             best, feature, below, above, to_left)
        split = feature >= 0
        own = total[:, split]
        weighted = own * class_weight[:, None]
        mass = weighted.sum(axis=0)
        gain = (best[split] - (weighted ** 2).sum(axis=0) / mass) / mass
        children = np.stack([to_left[:, split], own - to_left[:, split]], axis=2).reshape(classes, -1)
        child_ids = made + np.arange(children.shape[1])
        child_tree = np.repeat(tree[split], 2)
        splits.append((ids[split], feature[split], between(below[split], above[split]), child_ids[::2], gain))
        out.append((child_ids, child_tree, children))
        made += len(child_ids)

        mixed = np.count_nonzero(children, axis=0) > 1
        child = np.cumsum(split) * 2 - 2       # left child of a split node
        high = flat[feature[at] * n + row] > below[at]
        child = child[at] + high
        keep = split[at]
        keep[keep] = mixed[child[keep]]
        number = np.cumsum(mixed) - 1
        row, packed, at = row[keep], packed[keep], number[child[keep]]
        ids, tree, total = child_ids[mixed], child_tree[mixed], children[:, mixed]
    return _by_tree(out, splits, class_weight)


def _drawn(n: int, seed: int, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that a tree draws, and how often."""
    times = np.bincount(np.random.default_rng([seed, tree]).integers(0, n, n), minlength=n)
    row = np.flatnonzero(times)
    return row.astype(np.int32 if n < 1 << 31 else np.int64), times[row].astype(np.uint16)


def _best_thresholds(flat, n, tried, row, at, packed, some, low_bits, weight_bits, total, class_weight,
                     best, feature, below, above, to_left) -> None:
    """Note each node's best threshold of the feature ``tried`` for it, where it is better than the best so far."""
    if some is not None:
        inside = some[at]
        row, at, packed = row[inside], at[inside], packed[inside]
        total = np.where(some, total, 0.0)
    key = at.astype(np.uint64) << np.uint64(VALUE_BITS)
    key |= flat[tried[at] * n + row]
    key <<= low_bits
    key |= packed
    key.sort()
    value = key >> low_bits
    key &= (np.uint64(1) << low_bits) - np.uint64(1)
    kind = (key >> np.uint64(weight_bits)).astype(np.uint8)
    mass = (key & np.uint64((1 << weight_bits) - 1)).astype(np.int64)
    del key
    last = np.flatnonzero(value[1:] != value[:-1])         # a value's last row in its node
    if not len(last):
        return
    # the least and the largest class of a value: rows of a value are in the order of their classes.
    # Between two values that have one class, and the same one, no threshold is the best.
    least, most = kind[np.append(0, last + 1)], kind[np.append(last, len(kind) - 1)]
    last = last[(least[:-1] != most[:-1]) | (least[1:] != most[1:]) | (least[:-1] != least[1:])]
    node = (value[last] >> np.uint64(VALUE_BITS)).astype(np.int64)
    inner = node == (value[last + 1] >> np.uint64(VALUE_BITS)).astype(np.int64)
    last, node = last[inner], node[inner]
    if not len(last):
        return
    score, count = np.zeros(len(last)), np.empty((len(total), len(last)))
    left, right = np.zeros(len(last)), np.zeros(len(last))
    left_squares, right_squares = np.zeros(len(last)), np.zeros(len(last))
    for c, w in enumerate(class_weight):
        before = np.cumsum(total[c]) - total[c]            # rows of earlier nodes
        count[c] = np.cumsum(np.where(kind == c, mass, 0))[last] - before[node]
        a, b = count[c] * w, (total[c][node] - count[c]) * w
        left += a
        right += b
        left_squares += a * a
        right_squares += b * b
    score = left_squares / left + right_squares / right
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    top = np.repeat(np.maximum.reduceat(score, first), np.diff(np.append(first, len(node))))
    hit = np.flatnonzero(score == top)
    hit = hit[np.append(True, node[hit[1:]] != node[hit[:-1]])]
    hit = hit[score[hit] > best[node[hit]]]
    where, i = node[hit], last[hit]
    best[where], feature[where], to_left[:, where] = score[hit], tried[where], count[:, hit]
    below[where] = (value[i] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    above[where] = (value[i + 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _by_tree(out: list, splits: list, class_weight: np.ndarray) -> Nodes:
    tree = np.concatenate([t for _, t, _ in out])          # nodes were numbered as they were made
    stats = np.concatenate([s.T for _, _, s in out]) * class_weight
    feature, threshold = np.full(len(tree), -1), np.zeros(len(tree))
    left, gain = np.full(len(tree), -1), np.zeros(len(tree))
    for ids, f, t, child, g in splits:
        feature[ids], threshold[ids], left[ids], gain[ids] = f, t, child, g
    order = np.argsort(tree, kind="stable")
    tree = tree[order]
    start = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
    inside = np.arange(len(tree)) - np.repeat(start, np.diff(np.append(start, len(tree))))
    place = np.empty(len(tree), np.int64)
    place[order] = inside
    leaf = left < 0
    to_left = np.where(leaf, -1, place[left])
    to_right = np.where(leaf, -1, place[np.where(leaf, 0, left + 1)])
    return Nodes(tree, feature[order], threshold[order], to_left[order], to_right[order], gain[order], stats[order])
