"""The best points of many queries in one pass: a task scores its points against a block of queries and keeps the best so far.

What leaves a task is at most the wanted number of points per query, so what is moved grows with tasks and queries,
not with the pairs that share a term.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator

import numpy as np

#: Points that are scored at once, terms of a block that are held as a dense matrix, and a block's most queries and entries.
ROWS = 256
DENSE = 1024
QUERIES = 8192
ENTRIES = 2_000_000
#: A term that at least this part of the queries has is held as a row of the dense matrix; pairs of other terms are added one by one.
COMMON = 1 / 20
#: Pairs that are added at once.
PAIRS = 2_000_000


class Block:
    """Queries as a sparse matrix: entries (column, query, value); a column is a term, or a term with one weight.

    `most` bounds a point's value in a column where it is known to be a whole number up to there.
    """

    def __init__(self, columns: np.ndarray, queries: np.ndarray, values: np.ndarray, n_columns: int, n_queries: int, most: int | None = None):
        order = np.argsort(columns, kind="stable")
        self.n = n_queries
        self.queries, self.values = queries[order], values[order]
        self.sizes = np.bincount(columns, minlength=n_columns)
        self.starts = np.cumsum(self.sizes) - self.sizes
        common = np.argsort(-self.sizes, kind="stable")[:DENSE]
        self.common = common[self.sizes[common] >= max(1, n_queries * COMMON)]
        self.place = np.full(n_columns, -1)
        self.place[self.common] = np.arange(len(self.common))
        self.largest = int(np.abs(values).max(initial=0))
        total = np.bincount(queries, np.abs(values), minlength=n_queries).max(initial=0)
        self.small = most is not None and most * total < 2**24
        self._dense: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": {}}

    def _pairs(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position among `columns`, entry) of all entries of the columns."""
        sizes = self.sizes[columns]
        at = np.repeat(np.arange(len(columns)), sizes)
        return at, np.arange(len(at)) + np.repeat(self.starts[columns] - (np.cumsum(sizes) - sizes), sizes)

    def _matrix(self, kind: type) -> np.ndarray:
        if kind not in self._dense:
            m = np.zeros((len(self.common), self.n), kind)
            at, entry = self._pairs(self.common)
            m[at, self.queries[entry]] = self.values[entry]
            self._dense[kind] = m
        return self._dense[kind]

    def scores(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int) -> np.ndarray:
        """Sums of value * entry as a matrix (row, query); sums of whole numbers are exact."""
        if values.dtype.kind == "f":
            kind = np.float64
        elif self.small:
            kind = np.float32
        else:  # beyond 53 bits whole numbers are multiplied as such, which is slow
            most = np.bincount(rows, np.abs(values), minlength=n_rows).max(initial=0) * max(1, self.largest)
            kind = np.float64 if most < 2**53 else np.int64
        place = self.place[columns]
        dense = place >= 0
        own = np.zeros((n_rows, len(self.common)), kind)
        np.add.at(own, (rows[dense], place[dense]), values[dense].astype(kind))
        out = own @ self._matrix(kind)
        flat = out.reshape(-1)
        rows, columns, values = rows[~dense], columns[~dense], values[~dense]
        ends = np.cumsum(self.sizes[columns])
        a = 0
        while a < len(columns):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            at, entry = self._pairs(columns[a:b])
            np.add.at(flat, rows[a:b][at] * self.n + self.queries[entry], (values[a:b][at] * self.values[entry]).astype(kind))
            a = b
        return out.astype(np.float64) if kind is np.int64 else out


class Best:
    """The `k` best (score, then smaller key) of each of `n` queries among the points seen so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.keys: np.ndarray | None = None
        self.query, self.score, self.rank = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self._merge()

    def _merge(self) -> None:
        query, score, rank = (np.concatenate([own, *more]) for own, more in zip((self.query, self.score, self.rank), zip(*self.pending) if self.pending else ((), (), ())))
        order = np.lexsort((rank, -score, query))
        query = query[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[nth < self.k]
        last = order[nth == self.k - 1]
        self.least, self.last = np.full(self.n, -np.inf), np.zeros(self.n, np.int64)
        whole = query[nth == self.k - 1]
        self.least[whole], self.last[whole] = score[last], rank[last]
        self.query, self.score, self.rank = query[nth < self.k], score[kept], rank[kept]
        self.pending, self.waiting = [], 0

    def begin(self, keys: np.ndarray) -> np.ndarray:
        """The ranks of the keys of the next points among all keys at hand."""
        self._merge()
        old = 0 if self.keys is None else len(self.keys)
        self.keys, at = np.unique(keys if self.keys is None else np.concatenate([self.keys, keys]), return_inverse=True)
        self.rank = at[:old][self.rank] if old else self.rank
        self._merge()
        return at[old:]

    def add(self, scores: np.ndarray, ranks: np.ndarray, shared: np.ndarray | None = None) -> None:
        """Scores (point, query) of points with these ranks; without `shared` (which pairs count), those above 0."""
        mask = scores >= self.least.astype(scores.dtype)
        if shared is not None:
            mask &= shared
        elif (self.least <= 0).any():
            mask &= scores > 0
        r, c = np.divmod(np.flatnonzero(mask), self.n)
        s = scores[r, c].astype(np.float64)
        better = (s > self.least[c]) | (ranks[r] < self.last[c])
        self.pending.append((c[better], s[better], ranks[r[better]]))
        self.waiting += int(better.sum())
        if self.waiting > self.n * self.k:
            self._merge()

    def end(self) -> None:
        """After the points of a `begin`: keys that are no longer needed go."""
        self._merge()
        used, self.rank = np.unique(self.rank, return_inverse=True)
        self.keys = self.keys[used]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, score)."""
        return self.query, (self.keys if self.keys is not None else np.empty(0, object))[self.rank], self.score


def add_points(best: Best, block: Block, keys: np.ndarray, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, positive: bool = True) -> None:
    """Scores points with `keys` by their entries (row, column, value) and keeps the best.

    With `positive` a score counts if it is above 0, otherwise if the point shares a column with the query.
    """
    ranks = best.begin(keys)
    by_key = np.argsort(ranks, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[by_key] = np.arange(len(keys))
    rows = place[rows]
    order = np.argsort(rows, kind="stable")
    rows, columns, values = rows[order], columns[order], values[order]
    at = n = 0
    while (at := at + n) < len(keys):
        # Until something bounds what is worth keeping, nearly every pair is kept, so the first points are few.
        n = min(ROWS if len(best.score) or at >= ROWS else 2 * best.k, ROWS, len(keys) - at)
        a, b = np.searchsorted(rows, [at, at + n])
        if a == b:
            continue
        own = rows[a:b] - at
        shared = None if positive or (values[a:b] > 0).all() else block.scores(own, columns[a:b], np.ones(b - a, np.int64), n) > 0
        best.add(block.scores(own, columns[a:b], values[a:b], n), ranks[by_key[at : at + n]], shared)
    best.end()


def distinct_queries(queries: Iterator[tuple[object, list, list]], most: int = QUERIES, entries: int = ENTRIES) -> Iterator[list[tuple[list, list, list]]]:
    """Blocks of ([ids], terms, values) from (id, terms, values): queries with the same terms and values are scored once."""
    block: dict[Hashable, tuple[list, list, list]] = {}
    size = members = 0
    for i, terms, values in queries:
        key = (tuple(terms), tuple(values))
        if block and key not in block and (len(block) >= most or size + len(terms) > entries) or members >= 16 * most:
            yield list(block.values())
            block, size, members = {}, 0, 0
        if key not in block:
            block[key] = ([], terms, values)
            size += len(terms)
        block[key][0].append(i)
        members += 1
    if block:
        yield list(block.values())


def spread_members(members: list[list], query: np.ndarray) -> tuple[list, np.ndarray]:
    """(ids, positions in `query`): every id of the members of each distinct query of the results."""
    sizes = np.array([len(m) for m in members])[query] if len(query) else np.empty(0, np.int64)
    return [i for q in query for i in members[q]], np.repeat(np.arange(len(query)), sizes)
