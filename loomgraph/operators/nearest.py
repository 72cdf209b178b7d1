"""The k nearest rows by cosine distance, a block of rows and queries at a time.

A product of unit vectors in double precision gives every distance within
``MARGIN``. Pairs that may be among the k best by it are computed again, summed
dimension by dimension as ``vector.cosine_distance`` does, and ranked by that. So
results are exact and no pair is left out. Rows come in the order of their keys:
of rows at one distance the earlier stay, so copies past the first k cost no more
than their product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: More than the error of a product of unit vectors (some 1e-16 a dimension).
MARGIN = 1e-11
#: Vectors shorter or longer are never judged by their product: it could lose digits or overflow.
LEAST, MOST = 1e-100, 1e100
#: Queries and rows in a product, which stays in a core's cache; pairs computed again at once.
QUERIES, ROWS, PAIRS = 256, 4096, 1 << 14


class Vectors:
    """Rows of an array column as doubles, padded with zeros, with their lengths and norms; a row with a null in it counts as zero."""

    def __init__(self, column: pa.Array) -> None:
        n, column = len(column), column.cast(pa.large_list(pa.float64()))
        flat, start = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
        self.size = np.diff(start)
        values = flat.to_numpy(zero_copy_only=False)
        wide = int(self.size.max(initial=0))
        row = np.repeat(np.arange(n), self.size)
        if (self.size == wide).all():
            self.x = values.reshape(n, wide).copy()
        else:
            self.x = np.zeros((n, wide))
            self.x[row, np.arange(len(values)) - start[row]] = values
        if flat.null_count:
            self.x[row[flat.is_null().to_numpy(zero_copy_only=False)]] = 0
        squares = np.zeros(n)
        with np.errstate(all="ignore"):
            for d in range(wide):
                squares += self.x[:, d] * self.x[:, d]
        self.norm = np.sqrt(squares)
        self.odd = ~((self.norm == 0) | (self.norm >= LEAST) & (self.norm <= MOST))  # also where it is no number
        self.unit = np.zeros_like(self.x)
        plain = ~self.odd & (self.norm > 0)
        self.unit[plain] = self.x[plain] / self.norm[plain, None]


def exact(q: Vectors, i: np.ndarray, v: Vectors, j: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, as ``vector.cosine_distance`` makes them."""
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        both = np.minimum(q.size[a], v.size[b])
        x, y, dot = v.x[b], q.x[a], np.zeros(len(a))
        with np.errstate(all="ignore"):
            for d in range(int(both.max(initial=0))):
                dot = np.where(d < both, dot + x[:, d] * y[:, d], dot)
            out[at : at + PAIRS] = 1.0 - np.where(v.norm[b] == 0, 0.0, dot / (v.norm[b] * q.norm[a]))
    return out


def rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Half away from zero, as SQL does."""
    if digits is None:
        return x
    with np.errstate(invalid="ignore"):
        return np.where(x < 0, np.ceil(x * 10.0**digits - 0.5), np.floor(x * 10.0**digits + 0.5)) / 10.0**digits


class Nearest:
    """The k best rows of each query among all rows added so far."""

    def __init__(self, queries: pa.Array, k: int, digits: int | None = None) -> None:
        self.q, self.k, self.digits, self.seen = Vectors(queries), k, digits, 0
        shape = (len(queries), k)
        self.distance, self.order, self.place = np.full(shape, np.nan), np.full(shape, np.nan), np.full(shape, -1)
        self.places: list[np.ndarray] = []
        self.keys: list[pa.Array] = []

    def add(self, keys: pa.Array, rows: pa.Array) -> None:
        """Rows in the order of their keys, all after those added before."""
        for at in range(0, len(rows), ROWS):
            v = Vectors(rows.slice(at, ROWS))
            for lo in range(0, len(self.q.norm), QUERIES):
                self._block(lo, min(lo + QUERIES, len(self.q.norm)), v)
            kept = np.unique(self.place[self.place >= self.seen])
            if len(kept):
                self.places.append(kept)
                self.keys.append(keys.slice(at, ROWS).take(pa.array(kept - self.seen)))
            self.seen += len(v.norm)

    def _block(self, lo: int, hi: int, v: Vectors) -> None:
        q, k = self.q, self.k
        if not k:
            return
        wide = min(q.x.shape[1], v.x.shape[1])
        like = q.unit[lo:hi, :wide] @ v.unit[:, :wide].T
        like[:, v.odd] = np.inf
        like[q.odd[lo:hi]] = np.inf
        # a row that comes now must be nearer than the k-th so far, by a whole step where distances are rounded
        full, last = self.place[lo:hi, -1] >= 0, self.order[lo:hi, -1]
        step = 0.0 if self.digits is None else 10.0**-self.digits
        least = 1.0 - np.where(full & ~np.isnan(last), last - step / 2 + MARGIN, np.inf)
        maybe = like >= least[:, None]
        if not maybe.any():
            return
        if like.shape[1] > k and np.count_nonzero(maybe) > 8 * k:
            many = np.flatnonzero(np.count_nonzero(maybe, axis=1) > 8 * k)
            # k rows of this block are at least so like, so all others that count are too; pairs without a product show nothing
            some = like[many]
            reach = -np.partition(np.where(np.isinf(some), np.inf, -some), k - 1, axis=1)[:, k - 1] - step - 2 * MARGIN
            maybe[many] &= some >= reach[:, None]
        i, j = np.divmod(np.flatnonzero(maybe), like.shape[1])
        distance = exact(q, i + lo, v, j)
        order = rounded(distance, self.digits)
        who = np.unique(i)
        held, slot = np.nonzero(self.place[lo + who] >= 0)
        old = (lo + who[held], slot)
        i = np.concatenate([who[held], i])
        distance, order, place = np.concatenate([self.distance[old], distance]), np.concatenate([self.order[old], order]), np.concatenate([self.place[old], j + self.seen])
        best = np.lexsort((place, order, i))
        i = i[best]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        at = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        best, i, at = best[at < k], i[at < k] + lo, at[at < k]
        self.distance[i, at], self.order[i, at], self.place[i, at] = distance[best], order[best], place[best]

    def rows(self, at_once: int = 1 << 16) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
        """(query's place, key, distance, the distance by which it ranks) of all that were kept."""
        if not self.keys:
            return
        places, keys = np.concatenate(self.places), pa.concat_arrays(self.keys)
        q, slot = np.nonzero(self.place >= 0)
        for lo in range(0, len(q), at_once):
            x = (q[lo : lo + at_once], slot[lo : lo + at_once])
            yield x[0], keys.take(pa.array(np.searchsorted(places, self.place[x]))), self.distance[x], self.order[x]
