"""Exact cosine top-k inside a task: blocked matrix products."""

from __future__ import annotations

import numpy as np


def stacked(vectors) -> np.ndarray:
    """A series of vectors as a 2-d float64 array; all must have one length."""
    if len({len(v) for v in vectors}) > 1:
        raise ValueError("vectors differ in length")
    return np.stack(list(vectors)).astype(np.float64)


def unit_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and which rows have a length at all."""
    if not m.size:
        return m, np.zeros(len(m), dtype=bool)
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    ok = norms > 0
    scaled = np.zeros_like(m)
    scaled[ok] = m[ok] / norms[ok, None]
    return scaled, ok


#: Numbers of one score matrix.
BLOCK_VALUES = 4_000_000


def block_rows(queries: int, values: int = BLOCK_VALUES) -> int:
    """Rows that are scored against all queries of a task at once."""
    return max(1, values // max(1, queries))


def top_k(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int, threshold: float | None,
          values: int = BLOCK_VALUES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows per query by cosine, then id: query ids, row ids, scores.

    Rows are taken in blocks, so that no score matrix has more than ``values`` numbers; each block leaves what reaches the
    k-th best, ties included.
    """
    (asked, use_q), (offered, use_r) = unit_rows(queries), unit_rows(rows)
    query_ids, asked, row_ids, offered = query_ids[use_q], asked[use_q], row_ids[use_r], offered[use_r]
    by_id = np.argsort(row_ids, kind="stable")  # positions follow the ids from here on
    row_ids, offered = row_ids[by_id], offered[by_id]
    kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    step = block_rows(len(query_ids), values)
    for at in range(0, len(row_ids) if len(query_ids) else 0, step):
        # Rounding removes the last-bit noise of the product, so that copies tie and the id decides.
        scores = np.round(asked @ offered[at : at + step].T, 12)
        near = np.ones(scores.shape, bool) if threshold is None else scores >= threshold
        if scores.shape[1] > k:
            place = scores.shape[1] - k
            near &= scores >= np.partition(scores, place, axis=1)[:, place : place + 1]
        q, r = np.nonzero(near)
        q, r, s = np.concatenate([kept[0], q]), np.concatenate([kept[1], r + at]), np.concatenate([kept[2], scores[q, r]])
        order = np.lexsort((r, -s, q))
        q = q[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
        best = order[np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k]
        kept = tuple(np.concatenate([kept[i], new])[best] for i, new in enumerate((np.nonzero(near)[0], np.nonzero(near)[1] + at, scores[near])))
    return query_ids[kept[0]], row_ids[kept[1]], kept[2]
