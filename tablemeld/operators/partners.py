"""The best partner of a column name without scoring all pairs.

The matching-block ratio of two names is at most what their character counts allow, and that
bound is a matrix operation for one name against all others.  Partners are scored in the order of
their bounds until none that is left can win any more.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd

from tablemeld.functions import names

#: Weights of name, label and distribution in a match's confidence.
WEIGHTS = (0.5, 0.2, 0.3)


def rounded(x: float, digits: int = 3) -> float:
    """Half up on the decimal digits, as the engine rounds."""
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def letter_counts(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and, for every letter that occurs, how often each text has it."""
    low = [(t or "").lower() for t in texts]
    place = {c: k for k, c in enumerate(sorted(set("".join(low))))}
    counts = np.zeros((len(low), len(place)), np.int16)
    for row, text in enumerate(low):
        for c in text:
            counts[row, place[c]] += 1
    return np.array([len(t) for t in low], float), counts


def similarity_bounds(text: str, others: Sequence[str]) -> np.ndarray:
    """No matching-block ratio of the text and another is above its bound; empty texts match nothing."""
    size, counts = letter_counts([text, *others])
    shared = np.minimum(counts[0], counts[1:]).sum(1)
    with np.errstate(invalid="ignore"):
        return np.where((size[0] > 0) & (size[1:] > 0), 2.0 * shared / (size[0] + size[1:]), 0.0)


def best_partner(name: str, label: str, partners: pd.DataFrame) -> tuple[int, float, float, int]:
    """Place of the best partner, its name and label similarity, and how many were scored.

    ``partners`` has ``name``, ``label``, ``distribution`` and ``ord``.  The best has the highest
    rounded confidence, of equal ones the smallest ``ord``.
    """
    by_name, by_label, by_values = WEIGHTS
    fixed = by_values * partners["distribution"].to_numpy(float)
    bound = by_name * similarity_bounds(name, partners["name"].tolist()) + fixed
    if label:
        bound = bound + by_label * similarity_bounds(label, partners["label"].tolist())
    bound = bound + 1e-9  # sums of floats in another order
    order = np.lexsort((partners["ord"].to_numpy(), -bound))
    columns = [partners[c].tolist() for c in ("name", "label", "distribution", "ord")]
    best: tuple | None = None
    for scored, k in enumerate(order.tolist()):
        if best is not None and rounded(bound[k]) < -best[0]:
            return best[2], best[3], best[4], scored
        n = names.similarity(name, columns[0][k])
        t = names.similarity(label, columns[1][k]) if label else 0.0
        found = (-rounded(by_name * n + by_label * t + by_values * columns[2][k]), columns[3][k], k, n, t)
        if best is None or found[:2] < best[:2]:
            best = found
    assert best is not None
    return best[2], best[3], best[4], len(order)


def best_of_source(rows: pd.DataFrame) -> pd.DataFrame:
    """The best row of one source column against all target columns."""
    first = rows.iloc[0]
    partners = pd.DataFrame({"name": rows["target_column"], "label": rows["target_label"], "distribution": rows["distribution_similarity"], "ord": rows["t_ord"]})
    k, n, t, _ = best_partner(first["source_column"], first["source_label"], partners)
    return rows.iloc[[k]].assign(name=n, label=t)[["s_ord", "source_column", "t_ord", "target_column", "distribution_similarity", "name", "label"]]


BEST = "s_ord int, source_column string, t_ord int, target_column string, distribution_similarity double, name double, label double"
