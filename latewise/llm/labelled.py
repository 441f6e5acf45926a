"""Bounded samples of labelled rows and logistic calibration for the text classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewise.llm.common import staged


def shares(sizes: dict[int, list[tuple[int, int, int]]], rows: dict[int, int], max_bytes: int) -> dict[tuple[int, int], float]:
    """What share of each class's texts of like size is picked. ``sizes``: for each class its
    (magnitude of the size, texts, bytes). A class may have ``rows`` texts; the bytes go to the
    rarer class first, which leaves the other one what it wants or half of them. Where a class's
    bytes do not do, its longest texts are thinned, to as many bytes a text as fit."""
    out, left = {}, float(max_bytes)
    order = sorted((c for c in sizes if sizes[c]), key=lambda c: (sum(n for _, n, _ in sizes[c]), c))
    row_share = {c: min(1.0, rows[c] / sum(n for _, n, _ in sizes[c])) for c in order}
    wanted = {c: row_share[c] * sum(b for *_, b in sizes[c]) for c in order}
    for i, c in enumerate(order):
        budget = left - sum(min(wanted[o], max_bytes / len(order)) for o in order[i + 1:])
        # the most bytes a text of the class may add on average, so that all fit
        rest, n, limit = budget, sum(n for _, n, _ in sizes[c]), float("inf")
        if wanted[c] > budget:
            for _, own, size in sorted(sizes[c], key=lambda x: x[2] / x[1]):
                limit = rest / n
                if row_share[c] * size / own > limit:
                    break
                rest, n = rest - row_share[c] * size, n - own
        for magnitude, own, size in sizes[c]:
            out[c, magnitude] = min(row_share[c], limit * own / max(size, 1))
        left -= min(wanted[c], budget)
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: dict[int, int], max_bytes: int,
           doc_id: str = "doc_id", text: str = "text") -> dict[int, list[str]]:
    """Distinct whole texts of each class for fitting a classifier: about ``rows[c]`` of class c,
    and about ``max_bytes`` of text in all (see ``shares``), picked by a hash of id and text, so that
    the many texts of a repeated id are each picked for themselves. These bounds hold for any
    input, so the sample may go to the driver. Nothing else reads labels."""
    marked = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label")).where(F.col("__label").isin(*rows)).distinct()
    usable = docs.where(learn & F.col(text).isNotNull())
    row = [F.col(doc_id).alias("__id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("__hash")]
    found = staged(usable.select(*row, F.octet_length(text).alias("__bytes")).join(marked, "__id")
                   .withColumn("__mix", F.pmod("__hash", F.lit(1 << 20))).withColumn("__size", F.length(F.bin("__bytes"))), "labelled")
    sizes: dict[int, list[tuple[int, int, int]]] = {}
    for r in found.groupBy("__label", "__size").agg(F.count("*"), F.sum("__bytes")).collect():
        sizes.setdefault(r[0], []).append((r[1], r[2], r[3]))
    share = shares(sizes, rows, max_bytes)
    if not share:
        return {c: [] for c in rows}
    limit = F.create_map(*(F.lit(x) for (c, m), s in share.items() for x in (c * 64 + m, s * (1 << 20))))
    picked = found.where(F.col("__mix") < F.element_at(limit, F.col("__label") * 64 + F.col("__size"))).select("__id", "__hash", "__label").distinct()
    # about sum(rows.values()) keys: the texts stay where they are
    got = (usable.select(*row, F.col(text).alias("text")).join(F.broadcast(picked), ["__id", "__hash"])
           .select("__label", "text").distinct().toArrow())
    out: dict[int, list[str]] = {c: [] for c in rows}
    for c, t in zip(got["__label"].to_pylist(), got["text"].to_pylist(), strict=True):
        out[c].append(t)
    return {c: sorted(texts) for c, texts in out.items()}


class Logistic:
    """Logistic regression on standardised features, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._design(x)
        self.weights = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            slope = z.T @ (y - p) - ridge * len(z) * self.weights
            curve = (z * (p * (1 - p))[:, None]).T @ z + (ridge * len(z) + 1e-9) * np.eye(z.shape[1])
            self.weights = self.weights + np.linalg.solve(curve, slope)

    def _design(self, x):
        return np.concatenate(((x - self.mean) / self.scale, np.ones((len(x), 1))), axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -30, 30)))

