"""Forests as flat arrays: prediction of many rows by all trees at once, and exact attributions in polynomial time."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd

TREE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, default_left boolean, value double, cover double"
#: Rows x trees, and rows x leaves x path elements, that are held at once.
CELLS = 2_000_000


@dataclass
class Forest:
    """Trees in one table; children of leaves are -1. Feature order is part of the model."""

    features: list[str]
    base: float
    rows: list[tuple] = field(default_factory=list)

    def table(self) -> pd.DataFrame:
        return pd.DataFrame(self.rows, columns=[x.split()[0] for x in TREE_SCHEMA.split(", ")])

    @staticmethod
    def of(table: pd.DataFrame, features: list[str], base: float) -> Forest:
        return Forest(list(features), base, list(table.itertuples(index=False, name=None)))

    def _flat(self) -> dict[str, np.ndarray]:
        """All nodes in one sequence, with children as places in it; a leaf is its own child. Kept after the first call."""
        if self.__dict__.get("_rows") != len(self.rows):
            t = np.array([(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7], r[8]) for r in self.rows], float).reshape(-1, 9)
            t = t[np.lexsort((t[:, 1], t[:, 0]))]
            starts = np.flatnonzero(np.diff(t[:, 0], prepend=-1)) if len(t) else np.zeros(0, int)
            of = np.repeat(starts, np.diff(np.r_[starts, len(t)]))
            feature, own = t[:, 2].astype(int), np.arange(len(t))
            inner = feature >= 0
            left, right = (np.where(inner, of + t[:, k].astype(int), own) for k in (4, 5))
            self._nodes = {"roots": starts, "feature": feature, "threshold": t[:, 3].astype(np.float32), "left": left, "right": right, "default_left": t[:, 6] > 0, "value": t[:, 7], "cover": t[:, 8]}
            self._rows, self._leaves = len(self.rows), None
        return self._nodes

    def __getstate__(self) -> dict:
        return {"features": self.features, "base": self.base, "rows": self.rows}

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        n = self._flat()
        out = np.full(len(x), self.base)
        step = max(1, CELLS // max(1, len(n["roots"])))
        for at in range(0, len(x) if len(n["roots"]) else 0, step):
            part = x[at : at + step]
            rows = np.arange(len(part))[:, None]
            node = np.tile(n["roots"], (len(part), 1))
            while True:
                f = n["feature"][node]
                if (f < 0).all():
                    break
                v = part[rows, np.maximum(f, 0)]
                left = np.where(np.isnan(v), n["default_left"][node], v < n["threshold"][node])
                node = np.where(left, n["left"][node], n["right"][node])
            out[at : at + step] += n["value"][node].sum(axis=1)
        return out

    def expectation(self) -> float:
        n = self._flat()
        leaf = n["feature"] < 0
        whole = np.repeat(n["cover"][n["roots"]], np.diff(np.r_[n["roots"], len(leaf)])) if len(leaf) else np.zeros(0)
        return self.base + float((n["value"] * n["cover"] / whole)[leaf].sum()) if len(leaf) else self.base

    def leaves(self) -> dict[str, np.ndarray]:
        """Each leaf's path, a feature once: the interval [low, high) that leads there, whether a missing value does, and the share of cover.

        Paths are filled up to one length by elements that every row meets with share 1; these change no attribution.
        """
        n = self._flat()
        if self._leaves is None:
            paths, values = [], []
            stack = [(int(r), {}) for r in n["roots"]]
            while stack:
                node, path = stack.pop()
                f = int(n["feature"][node])
                if f < 0:
                    paths.append(path)
                    values.append(n["value"][node])
                    continue
                cut, low_high = float(n["threshold"][node]), path.get(f, (-np.inf, np.inf, True, 1.0))
                for child, to_left in ((int(n["left"][node]), True), (int(n["right"][node]), False)):
                    low, high, missing, share = low_high
                    met = (low, min(high, cut)) if to_left else (max(low, cut), high)
                    stack.append((child, {**path, f: (*met, missing and bool(n["default_left"][node]) == to_left, share * n["cover"][child] / n["cover"][node])}))
            depth = max(map(len, paths), default=0)
            filled = [[(f, *v) for f, v in p.items()] + [(-1, -np.inf, np.inf, True, 1.0)] * (depth - len(p)) for p in paths]
            a = np.array(filled, float).reshape(len(paths), depth, 5)
            self._leaves = {"feature": a[:, :, 0].astype(int), "low": a[:, :, 1], "high": a[:, :, 2], "missing": a[:, :, 3] > 0, "share": a[:, :, 4], "value": np.array(values, float)}
        return self._leaves

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """Exact path-dependent Shapley values, rows x features; with the expectation they sum to the prediction.

        A leaf whose path has d features is a game of d players: without player i it pays its share z_i, with it o_i (1 if the row meets
        its interval, else 0). The products over all coalitions of one size are the coefficients of prod(z_i + o_i t). That
        polynomial is extended a feature at a time; a player's own factor is then divided out again, and the
        coefficients left are weighted by the number of orders of such coalitions: d^2 steps a leaf, for all rows and leaves together.
        """
        x = x.astype(np.float32).astype(float)
        leaves = self.leaves()
        count, depth = leaves["feature"].shape
        phi = np.zeros((len(x), len(self.features)))
        if not depth:
            return phi
        weight = np.array([1 / (depth * _choose(depth - 1, k)) for k in range(depth)])
        used = [np.flatnonzero((leaves["feature"] == f).reshape(-1)) for f in range(len(self.features))]
        share, step = leaves["share"], max(1, CELLS // max(1, count * depth))
        for at in range(0, len(x), step):
            v = x[at : at + step][:, np.maximum(leaves["feature"], 0)]
            meets = np.where(np.isnan(v), leaves["missing"], (v >= leaves["low"]) & (v < leaves["high"])) | (leaves["feature"] < 0)
            c = np.zeros((depth + 1, len(v), count))
            c[0] = 1.0
            for i in range(depth):
                for k in range(i + 1, 0, -1):
                    c[k] = c[k] * share[:, i] + np.where(meets[:, :, i], c[k - 1], 0.0)
                c[0] *= share[:, i]
            paid = np.empty((len(v), count, depth))
            for i in range(depth):
                one, total, q = meets[:, :, i], np.zeros(c.shape[1:]), np.zeros(c.shape[1:])
                # with o = 1 the division goes from the highest power down, with o = 0 all coefficients carry the share
                for k in range(depth - 1, -1, -1):
                    q = c[k + 1] - share[:, i] * q
                    total += weight[k] * np.where(one, q, c[k] / share[:, i])
                paid[:, :, i] = leaves["value"] * (one - share[:, i]) * total
            flat = paid.reshape(len(v), -1)
            for f, places in enumerate(used):
                phi[at : at + step, f] = flat[:, places].sum(axis=1)
        return phi


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out
