"""Running values over rows that arrive sorted, computed inside the stage that sorts them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

Batches = Iterator[pa.RecordBatch]


def group_starts(batch: pa.RecordBatch, keys: Sequence[str], before: dict | None) -> np.ndarray:
    """Whether each row begins a group of equal keys; `before` is the last row of the batch before. Nulls are equal."""
    starts = np.zeros(batch.num_rows, dtype=bool)
    starts[0] = before is None
    for key in keys:
        column = batch.column(batch.schema.get_field_index(key))
        if before is not None:
            starts[0] |= column[0].as_py() != before[key]
        if batch.num_rows > 1:
            left, right = column.slice(0, batch.num_rows - 1), column.slice(1)
            differ = pa.compute.fill_null(pa.compute.not_equal(left, right), False)
            nulls = pa.compute.xor(left.is_null(), right.is_null())
            starts[1:] |= pa.compute.or_(differ, nulls).to_numpy(zero_copy_only=False)
    return starts


def restarted(values: np.ndarray, starts: np.ndarray, carried: float) -> tuple[np.ndarray, float]:
    """(sum of the earlier values of the row's group, that sum after the last row); `carried` belongs to the rows before
    the first start."""
    total = np.cumsum(values)
    first = np.maximum.accumulate(np.where(starts, np.arange(len(values)), -1))
    base = np.where(first < 0, -carried, (total - values)[np.maximum(first, 0)])
    return total - values - base, (total - base)[-1]


def running_sums(keys: Sequence[str], sums: Sequence[str], columns: Sequence[str]) -> Callable[[Batches], Batches]:
    """The pass over sorted rows that adds `_part`, `_pos`, and per column of `sums` `_r_<c>`: the sum over the earlier
    rows of its group in this partition. Columns of `sums` are whole numbers without nulls."""

    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before: dict | None = None
        carried = dict.fromkeys(sums, 0)
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = group_starts(batch, keys, before)
            added = []
            for name in sums:
                values = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)
                sofar, carried[name] = restarted(values, starts, carried[name])
                added.append(pa.array(sofar.astype(np.int64)))
            last = batch.slice(batch.num_rows - 1)
            before = {key: last.column(batch.schema.get_field_index(key))[0].as_py() for key in keys}
            place = [pa.array(np.full(batch.num_rows, part, dtype=np.int32)), pa.array(seen + np.arange(batch.num_rows))]
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *place, *added], names=[*columns, "_part", "_pos", *[f"_r_{c}" for c in sums]]
            )

    return run


def sessions(timeout: int) -> Callable[[Batches], Batches]:
    """The pass over (user_id, item_id, emitted) rows sorted by user and time.

    It adds `part`, `opened` (sessions opened by a gap so far, of this user in this partition), `opened_at` (time of
    the last of them, if any) and `first_at` (the user's first time in this partition).
    """

    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before: dict | None = None
        opened_before, last_at, opened_at, first_at = 0, None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = batch.column(2)
            valid = at.is_valid().to_numpy(zero_copy_only=False)
            micros = pa.compute.fill_null(at.cast(pa.int64()), 0).to_numpy()
            starts = group_starts(batch, ["user_id"], before)
            row = np.arange(n)
            earlier = np.concatenate(([last_at or 0], micros[:-1]))
            comparable = valid & ~starts & np.concatenate(([last_at is not None], valid[:-1]))
            opens = comparable & ((earlier > micros) | ((micros - earlier) // 1_000_000 > timeout))
            opened, _ = restarted(opens.astype(np.int64), starts, opened_before)
            opened = (opened + opens).astype(np.int64)
            opened_before = int(opened[-1])
            # Places of the last opening and the first time within the user's rows; before the batch where below zero.
            latest = np.maximum.accumulate(np.where(opens | starts, row, -1))
            latest = np.where((latest >= 0) & opens[np.maximum(latest, 0)], latest, np.where(latest >= 0, n + 1, -1))
            times = [_at(micros, latest, opened_at, n)]
            times.append(_at(micros, _first_known(valid, starts, first_at), first_at, n))
            opened_at, first_at = times[0][-1].as_py(), times[1][-1].as_py()
            last_at = int(micros[-1]) if valid[-1] else None
            before = {"user_id": batch.column(0)[n - 1].as_py()}
            stamps = [t.cast(at.type) for t in times]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(opened), *stamps],
                names=["user_id", "item_id", "emitted", "part", "opened", "opened_at", "first_at"],
            )

    return run


def _first_known(valid: np.ndarray, starts: np.ndarray, carried: int | None) -> np.ndarray:
    """Place of the first valid row of each row's group up to it: -1 for the carried value, len + 1 if there is none."""
    n = len(valid)
    group = np.cumsum(starts)
    rows = np.flatnonzero(valid)
    out = np.full(n, n + 1)
    if len(rows):
        at = np.searchsorted(group[rows], group)
        place = rows[np.minimum(at, len(rows) - 1)]
        fits = (at < len(rows)) & (group[place] == group) & (place <= np.arange(n))
        out[fits] = place[fits]
    if carried is not None:
        out[group == 0] = -1
    return out


def _at(micros: np.ndarray, place: np.ndarray, carried: int | None, n: int) -> pa.Array:
    """The times at the given places: the carried one below zero, none beyond the rows."""
    values = np.where(place < 0, carried or 0, micros[np.clip(place, 0, n - 1)])
    missing = (place > n - 1) | ((place < 0) & (carried is None))
    return pa.array(values, mask=missing, type=pa.int64())
