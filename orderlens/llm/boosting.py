"""Gradient-boosted classification trees over a small, bounded table of examples.

The steps are those of Spark's ``GBTClassifier``: at most 32 bins a feature, splits by the variance of the residuals of the
logistic loss, leaves by their mean. That class runs two stages for every level of every tree and sends its tasks out anew
each time, whatever the number of rows; for a few thousand examples those broadcasts filled the driver's heap. Here the
table is collected once and the trees grow on the driver. The fit never reads the documents.
"""

from __future__ import annotations

BINS = 32
_EQUAL = 1e-9  # gains closer than this share of a node's mean square are equal but for rounding


class Leaf:
    def __init__(self, value: float):
        self._value = value

    def prediction(self) -> float:
        return self._value


class Split:
    """A node with two children, with the methods of Spark's nodes; values up to the threshold go left."""

    def __init__(self, feature: int, threshold: float, left, right):
        self._feature, self._threshold, self._children = feature, threshold, (left, right)

    def split(self):
        return self

    def featureIndex(self) -> int:
        return self._feature

    def threshold(self) -> float:
        return self._threshold

    def leftChild(self):
        return self._children[0]

    def rightChild(self):
        return self._children[1]


def _limits(values):
    """Thresholds between the distinct values of a feature, spaced evenly by rows if there are more than BINS."""
    import numpy as np

    found, counts = np.unique(values, return_counts=True)
    between = (found[:-1] + found[1:]) / 2
    if len(between) < BINS:
        return between
    stride = aim = len(values) / BINS
    chosen, seen = [], np.cumsum(counts)
    for i in range(1, len(found)):
        if abs(seen[i - 1] - aim) < abs(seen[i] - aim):
            chosen.append(between[i - 1])
            aim += stride
    return np.array(chosen)


def _variance(n, total, squares):
    return (squares - total * total / n) / n


def _best(bins, limits, target, n, total, squares):
    """Feature and number of the threshold that lower a node's variance most, or None; of equal ones the first."""
    import numpy as np

    before, gains = _variance(n, total, squares), []
    for feature, within in enumerate(bins):
        size = len(limits[feature]) + 1
        summed = np.cumsum([np.bincount(within, w, size) for w in (np.ones(len(target)), target, target * target)], axis=1)
        left, right = summed[:, :-1], summed[:, -1:] - summed[:, :-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = before - left[0] / n * _variance(*left) - right[0] / n * _variance(*right)
        gains.append(np.where((left[0] > 0) & (right[0] > 0), gain, -1.0))
    every, least = np.concatenate(gains), _EQUAL * squares / n
    if not len(every) or every.max() <= least:
        return None
    at = int(np.argmax(every >= every.max() - least))
    for feature, gain in enumerate(gains):
        if at < len(gain):
            return feature, at
        at -= len(gain)


def _tree(bins, limits, target, depth: int):
    """A regression tree for ``target`` and its value for every row."""
    import numpy as np

    fitted = np.zeros(len(target))

    def node(rows, level):
        own = target[rows]
        n, total, squares = len(rows), own.sum(), (own * own).sum()
        best = _best(bins[:, rows], limits, own, n, total, squares) if level < depth else None
        if best is None:
            fitted[rows] = total / n
            return Leaf(float(total / n))
        feature, at = best
        left = bins[feature, rows] <= at
        return Split(feature, float(limits[feature][at]), node(rows[left], level + 1), node(rows[~left], level + 1))

    return node(np.arange(len(target)), 0), fitted


def fit(features: list[list[float]], labels: list[int], *, trees: int, depth: int, step: float) -> list[tuple[float, object]]:
    """Weights and roots of the trees; ``labels`` are 0 or 1. Equal rows in equal order give equal trees wherever it runs."""
    import numpy as np

    values, sign = np.array(features, np.float64), 2.0 * np.array(labels) - 1
    limits = [_limits(column) for column in values.T]
    bins = np.array([np.searchsorted(limit, column) for limit, column in zip(limits, values.T)])
    made, margin = [], np.zeros(len(sign))
    for number in range(trees):
        target = 4 * sign / (1 + np.exp(2 * sign * margin)) if number else sign
        root, fitted = _tree(bins, limits, target, depth)
        made.append((step if number else 1.0, root))
        margin += made[-1][0] * fitted
    return made
