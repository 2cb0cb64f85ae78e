"""The best rows of each group, kept in place: a task holds and hands on a bounded number of rows a group."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

#: Rows that wait to be sorted in.
WAITING = 1 << 19


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """As the engine's round: half away from zero, of the shortest decimal that stands for the number."""
    scale = 10.0**digits
    with np.errstate(all="ignore"):
        size = np.abs(values) * scale
        low = np.floor(size)
        out = np.where(np.isfinite(values), np.copysign((low + (size - low >= 0.5)) / scale, values), values)
        near = np.flatnonzero(np.abs(size - low - 0.5) < np.maximum(1e-3, size * 4e-16))
    for i in near:
        out[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


class Best:
    """The ``limit`` highest scores (rounded to ``digits``, if given) of each of ``groups``; equal ones by smaller id."""

    def __init__(self, groups: int, limit: int, digits: int | None = None) -> None:
        self.groups, self.limit, self.digits = groups, limit, digits
        self.margin = 0.0 if digits is None else 2 * 10.0**-digits
        self.least = np.full(groups, -np.inf)
        self.waiting: list[pa.Table] = []
        self.n = 0

    def offer(self, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores by group and row, minus infinity where a row is not listed, and the rows' ids."""
        rows = scores.shape[1]
        floor = self.least - self.margin
        take = (scores >= floor[:, None]) & (scores > -np.inf)
        if rows > self.limit and np.count_nonzero(take) > self.groups * self.limit:
            kth = np.partition(scores, rows - self.limit, axis=1)[:, rows - self.limit]
            take &= scores >= (kth - self.margin)[:, None]
        group, row = np.nonzero(take)
        if len(group):
            values = scores[group, row]
            values = values if self.digits is None else rounded(values, self.digits)
            self.waiting.append(pa.table({"g": group.astype(np.int64), "s": values, "id": ids.take(pa.array(row))}))
            self.n += len(group)
        if self.n > max(WAITING, 2 * self.groups * self.limit):
            self._sort()

    def _sort(self) -> None:
        if not self.waiting:
            return
        rows = pa.concat_tables(self.waiting).sort_by([("g", "ascending"), ("s", "descending"), ("id", "ascending")])
        group = rows["g"].to_numpy()
        start = np.searchsorted(group, group, side="left")
        place = np.arange(len(group)) - start
        rows = rows.filter(pa.array(place < self.limit))
        last = place == self.limit - 1
        self.least[group[last]] = rows["s"].to_numpy()[last[place < self.limit]]
        self.waiting, self.n = [rows.combine_chunks()], rows.num_rows

    def batches(self, names: pa.Array, group: str, row: str, score: str) -> Iterator[pa.RecordBatch]:
        """What is left, with the groups' names; an infinite score stands for one that is no number."""
        self._sort()
        for rows in self.waiting:
            values = rows["s"].to_numpy()
            made = pa.table({group: names.take(rows["g"].combine_chunks()), row: rows["id"], score: np.where(np.isposinf(values), np.nan, values)})
            yield from made.combine_chunks().to_batches(max_chunksize=100_000)
