"""The best rows per query, kept while a task reads its rows."""

from __future__ import annotations

import numpy as np


class RunningBest:
    """At most ``k`` rows per query: highest score first, then the smaller id. Ids are of one sortable kind."""

    def __init__(self, k: int):
        self.k = k
        self.query, self.score, self.id = np.empty(0, np.int64), np.empty(0), None

    def take(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if self.id is not None:
            query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        place = np.unique(ids, return_inverse=True)[1] if len(ids) else np.empty(0, np.int64)
        order = np.lexsort((place, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.query, self.score, self.id = query[kept], score[kept], ids[kept]

    def least(self, queries: int) -> np.ndarray:
        """The score of the ``k``-th row of each query, minus infinity where there are fewer."""
        out = np.full(queries, -np.inf)
        if len(self.query):
            rank = np.arange(len(self.query)) - np.searchsorted(self.query, self.query)
            out[self.query[rank == self.k - 1]] = self.score[rank == self.k - 1]
        return out
