"""Small numpy helpers that run inside Spark tasks on bounded blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Pairs of one matrix product, whatever the sizes of the two sides.
PRODUCT_PAIRS = 1 << 20
#: Pairs measured one by one at a time.
MEASURED_PAIRS = 1 << 15


def unit_rows(vectors) -> np.ndarray:
    """Rows scaled to length one. A zero row stays zero: distance 1 to all."""
    matrix = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def first_copies(rows: np.ndarray, k: int) -> np.ndarray:
    """Which rows to keep, in order, so that of equal rows the first k are left."""
    if len(rows) <= k:
        return np.arange(len(rows))
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    order = np.argsort(whole, kind="stable")
    new = np.append(True, whole[order][1:] != whole[order][:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return np.sort(order[np.arange(len(order)) - start < k])


def _measured(queries: np.ndarray, block: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances measured one by one, which gives copies of a vector the same distance anywhere."""
    found = np.empty(len(rows))
    for at in range(0, len(rows), MEASURED_PAIRS):
        part = slice(at, at + MEASURED_PAIRS)
        found[part] = 1.0 - (queries[rows[part]] * block[cols[part]]).sum(axis=1)
    return found


def _first_k(rows: np.ndarray, cols: np.ndarray, found: np.ndarray, k: int):
    order = np.lexsort((cols, found, rows))
    rows, cols, found = rows[order], cols[order], found[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], cols[keep], found[keep]


def nearest_in_block(queries: np.ndarray, block: np.ndarray, k: int, at_once: int = 4096):
    """(query row, block row, distance) of each query's k nearest block rows.

    Ties go to the earlier block row. Queries have length one or zero. The block is gone through `at_once` rows at a time:
    products in single precision leave out what is farther than a query's k-th so far by more than they can
    be off, and the few others are measured in double precision. No array grows with queries times rows.
    """
    if block.shape[0] <= k:
        rows, cols = (i.ravel() for i in np.indices((len(queries), len(block))))
        return _first_k(rows, cols, _measured(queries, block, rows, cols), k)
    # A product is off by less than a rounding per term and two for the rows themselves, times the rows' lengths.
    longest = np.fmax.reduce(np.linalg.norm(block, axis=1), initial=1.0)
    off = np.float32((queries.shape[1] + 8) * 2.0**-23 * longest)
    rough_queries, rough_block = queries.astype(np.float32), block.astype(np.float32)
    at_once = min(len(block), max(at_once, k))
    some = max(1, PRODUCT_PAIRS // at_once)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    results = [none]
    for low in range(0, len(queries), some):
        asked = rough_queries[low : low + some]
        best = none
        for first in range(0, len(block), at_once):
            near = asked @ rough_block[first : first + at_once].T
            if first == 0:
                at_least = -np.partition(-near, k - 1, axis=1)[:, k - 1] - 2 * off
                at_least = np.where(np.isnan(at_least), -np.inf, at_least).astype(np.float32)
            rows, cols = np.divmod(np.flatnonzero(near >= at_least[:, None]), near.shape[1])
            if not len(rows):
                continue
            cols += first
            found = _measured(queries, block, rows + low, cols)
            new = rows, cols, found
            best = _first_k(*(np.concatenate(pair) for pair in zip(best, new)), k)
            full = np.flatnonzero(np.arange(len(best[0])) - np.searchsorted(best[0], best[0], side="left") == k - 1)
            at_least[best[0][full]] = (1.0 - best[2][full]).astype(np.float32) - off
        results.append((best[0] + low, best[1], best[2]))
    return tuple(np.concatenate(part) for part in zip(*results))


def block_candidates(
    query_ids: np.ndarray, queries: np.ndarray, block: pd.DataFrame, k: int, rows_of=unit_rows
) -> pd.DataFrame:
    """The k nearest rows of a block (`id`, `vector`) for each query. Of copies of a vector no more than the
    first k can be among them; the others are left out beforehand."""
    block = block.sort_values("id", kind="stable")
    vectors = rows_of(block["vector"])
    kept = first_copies(vectors, k)
    rows, cols, found = nearest_in_block(queries, vectors[kept], k)
    return pd.DataFrame(
        {
            "query": query_ids[rows],
            "id": block["id"].to_numpy()[kept][cols],
            "distance": found,
        }
    )
