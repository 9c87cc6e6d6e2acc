"""WKB bytes to the canonical geometry, one Arrow batch at a time.

Headers are gathered for the whole batch with numpy, one level of nesting and one
item of every value at a time; collections, damaged values and the few that have
many more items than the rest are read one by one. What results is a table of
coordinate runs (byte position, stride, count), from which all coordinates are
gathered at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# WKB type codes. Fixed values.
NAMES = {
    1: "Point",
    2: "LineString",
    3: "Polygon",
    4: "MultiPoint",
    5: "MultiLineString",
    6: "MultiPolygon",
}
COLLECTION = 7
_MULTI = {4: 1, 5: 2, 6: 3}  # multi type: type of its items

GATHER = 1 << 16  # coordinates fetched at once
LONG_RUN = 32  # from this mean length on, runs are copied one by one

# Columns of the run table.
ROW, MEMBER, PART, RING, START, STRIDE, COUNT, BIG = range(8)


#: Values that are still being read together; fewer are left to ``Walk``.
TOGETHER = 16


def _u32(data: np.ndarray, at: np.ndarray, big: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<u4").ravel()
    return np.where(big, raw.byteswap(), raw).astype(np.int64)


def _headers(data: np.ndarray, at: np.ndarray, end: np.ndarray):
    """(readable?, big-endian?, type, bytes per vertex, position after) of each header."""
    ok = at + 5 <= end
    at = np.where(ok, at, 0)
    order = data[at] if len(data) else np.zeros(len(at), np.uint8)
    ok &= order <= 1
    big = order == 0
    code = np.zeros(len(at), np.int64)
    code[ok] = _u32(data, at[ok] + 1, big[ok])
    dims = 2 + (code & 0x80000000 > 0) + (code & 0x40000000 > 0)
    after = at + 5 + 4 * (code & 0x20000000 > 0)
    code &= 0x0FFFFFFF
    stride = 8 * (dims + np.array([0, 1, 1, 2])[np.minimum(code // 1000, 3)])
    return ok, big, code % 1000, stride, after


def _counts(data: np.ndarray, at: np.ndarray, end: np.ndarray, big: np.ndarray):
    """(readable?, the number at each position)."""
    ok = at + 4 <= end
    n = np.zeros(len(at), np.int64)
    n[ok] = _u32(data, at[ok], big[ok])
    return ok, n


class Walk:
    """Reads headers of single values of any type into runs and members."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.runs: list[tuple] = []
        self.members: list[tuple] = []  # (row, type code)

    def _count(self, at: int, end: int, big: bool) -> int:
        if at + 4 > end:
            raise ValueError("truncated WKB")
        return int.from_bytes(self.data[at:at + 4].tobytes(), "big" if big else "little")

    def _header(self, at: int, end: int) -> tuple[bool, int, int, int]:
        """(big-endian?, type, bytes per vertex, position after the header)."""
        if at + 5 > end:
            raise ValueError("truncated WKB")
        if self.data[at] > 1:
            raise ValueError("bad byte order")
        big = self.data[at] == 0
        code, at = self._count(at + 1, end, big), at + 5
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            at += 4
        code &= 0x0FFFFFFF
        return big, code % 1000, 8 * (dims + (0, 1, 1, 2)[min(code // 1000, 3)]), at

    def _run(self, at: int, end: int, stride: int, count: int) -> int:
        after = at + stride * count
        if after > end:
            raise ValueError("truncated WKB")
        return after

    def _shape(self, place: tuple, at: int, end: int, nested: int = 0) -> int:
        """Note the runs of the geometry at ``at``; where it ends."""
        row, member, part, ring = place
        big, code, stride, at = self._header(at, end)
        if nested and code != nested:
            raise ValueError("wrong item in a multi-geometry")
        if not nested:
            if code == COLLECTION:
                raise ValueError("nested collection")
            if code not in NAMES:
                raise ValueError(f"unknown WKB type {code}")
            self.members.append((row, code))
        if code == 1:
            after = self._run(at, end, stride, 1)
            self.runs.append((row, member, part, ring, at, stride, 1, big))
            return after
        n, at = self._count(at, end, big), at + 4
        if code == 2:
            after = self._run(at, end, stride, n)
            self.runs.append((row, member, part, ring, at, stride, n, big))
            return after
        for i in range(n):
            if code == 3:
                points, at = self._count(at, end, big), at + 4
                self.runs.append((row, member, part, i, at, stride, points, big))
                at = self._run(at, end, stride, points)
            elif code == 4:
                at = self._shape((row, member, part, ring), at, end, _MULTI[code])
            elif code == 5:
                at = self._shape((row, member, part, i), at, end, _MULTI[code])
            else:
                at = self._shape((row, member, i, 0), at, end, _MULTI[code])
        return at

    def value(self, row: int, at: int, end: int) -> None:
        """Note one value; nothing of it stays if it cannot be read."""
        marks = len(self.runs), len(self.members)
        try:
            big, code, _, inner = self._header(at, end)
            if code != COLLECTION:
                self._shape((row, 0, 0, 0), at, end)
                return
            n, inner = self._count(inner, end, big), inner + 4
            for member in range(n):
                inner = self._shape((row, member, 0, 0), inner, end)
        except ValueError:
            del self.runs[marks[0]:], self.members[marks[1]:]
            raise


class _Table:
    """Runs of values, by the values' places in the batch."""

    def __init__(self):
        self.blocks: list[np.ndarray] = []

    def add(self, of, part, ring, start, stride, count, big) -> None:
        block = np.zeros((len(of), 8), dtype=np.int64)
        for column, value in ((ROW, of), (PART, part), (RING, ring), (START, start),
                              (STRIDE, stride), (COUNT, count), (BIG, big)):
            block[:, column] = value
        self.blocks.append(block)


def _plain_runs(data, rows, starts, ends):
    """Run and member tables of single values, with a mask of those they cover.

    Collections, values that cannot be read and the last few with many items are
    left to ``Walk``.
    """
    ok, big, code, stride, at = _headers(data, starts, ends)
    table, done = _Table(), np.zeros(len(rows), dtype=bool)

    ix = np.flatnonzero(ok & (code == 1))
    good = at[ix] + stride[ix] <= ends[ix]
    ix = ix[good]
    table.add(ix, 0, 0, at[ix], stride[ix], 1, big[ix])
    done[ix] = True

    ix = np.flatnonzero(ok & (code >= 2) & (code <= 6))
    fits, n = _counts(data, at[ix], ends[ix], big[ix])
    ix, n = ix[fits], n[fits]
    at[ix] += 4

    line = code[ix] == 2
    good = line & (at[ix] + stride[ix] * n <= ends[ix])
    of = ix[good]
    table.add(of, 0, 0, at[of], stride[of], n[good], big[of])
    done[of] = True

    points = code[ix] == 4
    # items all have the first one's header, as every writer writes them
    item_ok, item_big, item_code, item_stride, first = _headers(data, at[ix], ends[ix])
    size = first - at[ix] + item_stride
    good = points & ((n == 0) | (item_ok & (item_code == 1) & (at[ix] + size * n <= ends[ix])))
    good &= (n == 0) | (item_stride == stride[ix]) & (item_big == big[ix])
    of = ix[good]
    # coordinates of consecutive points lie a whole item apart
    table.add(of, 0, 0, first[good], size[good], n[good], big[of])
    done[of] = True

    nested = np.flatnonzero(np.isin(code[ix], (3, 5, 6)))
    of = ix[nested]
    done[_nested_runs(data, table, of, code[of], at[of], ends[of], big[of], stride[of], n[nested])] = True

    runs = [block[done[block[:, ROW]]] for block in table.blocks]
    for block in runs:
        block[:, ROW] = rows[block[:, ROW]]
    return runs, [np.column_stack([rows[done], code[done]])], done


def _nested_runs(data, table, of, code, at, end, big, stride, n):
    """Runs of polygons, multi-lines and multi-polygons, one item of each per step.

    Returns the values that were read to their end. Cost follows the items of all
    values, not the largest number of them: values that are done drop out.
    """
    finished = []
    polygons = code == 3
    state = {
        "of": of, "code": code, "at": at.copy(), "end": end, "big": big, "stride": stride,
        "items": np.where(polygons, 0, n), "rings": np.where(polygons, n, 0),
        "part": np.zeros(len(of), np.int64) - (code == 6), "ring": np.zeros(len(of), np.int64),
    }

    def keep(mask):
        for name in state:
            state[name] = state[name][mask]

    def fail(at_fault):
        if at_fault.any():
            keep(~at_fault)

    while len(state["of"]):
        idle = (state["items"] == 0) & (state["rings"] == 0)
        if idle.any():
            finished.append(state["of"][idle])
            keep(~idle)
        if len(state["of"]) < TOGETHER:
            break
        # the next item's own header, where one is due
        due = state["rings"] == 0
        ok, item_big, item_code, item_stride, after = _headers(data, state["at"], state["end"])
        wanted = np.where(state["code"] == 6, 3, 2)
        bad = due & ~(ok & (item_code == wanted))
        for name, value in (("big", item_big), ("stride", item_stride), ("at", after)):
            state[name] = np.where(due & ~bad, value, state[name])
        opens = due & ~bad & (state["code"] == 6)
        fits, rings = _counts(data, state["at"], state["end"], state["big"])
        bad |= opens & ~fits
        opens &= ~bad
        state["items"] = state["items"] - due
        state["rings"] = np.where(opens, rings, np.where(due & (state["code"] == 5), 1, state["rings"]))
        state["at"] = np.where(opens, state["at"] + 4, state["at"])
        state["part"] = state["part"] + opens
        state["ring"] = np.where(opens, 0, state["ring"])
        # one ring or line of each
        has = ~bad & (state["rings"] > 0)
        fits, points = _counts(data, state["at"], state["end"], state["big"])
        begin = state["at"] + 4
        last = begin + state["stride"] * points
        bad |= has & ~(fits & (last <= state["end"]))
        has &= ~bad
        table.add(state["of"][has], np.maximum(state["part"][has], 0), state["ring"][has], begin[has],
                  state["stride"][has], points[has], state["big"][has])
        state["at"] = np.where(has, last, state["at"])
        state["rings"] = state["rings"] - has
        state["ring"] = state["ring"] + has
        fail(bad)
    return np.concatenate([np.zeros(0, np.int64), *finished])


def _coordinates(data: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """(n, 2) doubles of all runs in order."""
    counts = runs[:, COUNT]
    total = int(counts.sum())
    if total == 0:
        return np.empty((0, 2))
    raw = np.empty((total, 2), dtype="<f8")
    if total >= LONG_RUN * len(runs):
        low = 0
        for start, stride, count in runs[:, [START, STRIDE, COUNT]].tolist():
            block = np.lib.stride_tricks.as_strided(data[start:], (count, 16), (stride, 1))
            raw[low:low + count] = np.ascontiguousarray(block).view("<f8")
            low += count
    else:
        within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(runs[:, START], counts) + np.repeat(runs[:, STRIDE], counts) * within
        for low in range(0, total, GATHER):  # the index is larger than what it fetches
            part = at[low:low + GATHER]
            raw[low:low + GATHER] = data[part[:, None] + np.arange(16)].view("<f8")
    big = np.repeat(runs[:, BIG], counts).astype(bool)
    if big.any():
        raw[big] = raw[big].byteswap()
    return raw


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in rows sorted by ``keys``."""
    if len(keys[0]) == 0:
        return np.zeros(0, dtype=np.int64)
    changed = np.zeros(len(keys[0]), dtype=bool)
    changed[0] = True
    for key in keys:
        changed[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(changed)


def _sizes(starts: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(starts, total))


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32))


def _assemble(data, runs, members, n_rows, null, errors) -> pa.Array:
    runs = runs[np.argsort(runs[:, ROW], kind="stable")]
    members = members[np.argsort(members[:, 0], kind="stable")]
    xy = _coordinates(data, runs)
    # An empty point is a vertex of NaNs: its run is emptied.
    nan = np.isnan(xy).any(axis=1)
    if nan.any():
        owner = np.repeat(np.arange(len(runs)), runs[:, COUNT])
        runs[:, COUNT] -= np.bincount(owner[nan], minlength=len(runs))
        xy = xy[~nan]
    # Parts without any vertex are left out.
    part_at = _starts(runs[:, ROW], runs[:, MEMBER], runs[:, PART])
    filled = np.add.reduceat(runs[:, COUNT], part_at) > 0 if len(runs) else np.zeros(0, bool)
    runs = runs[np.repeat(filled, _sizes(part_at, len(runs)))]

    ring_at = _starts(runs[:, ROW], runs[:, MEMBER], runs[:, PART], runs[:, RING])
    ring_sizes = np.add.reduceat(runs[:, COUNT], ring_at) if len(runs) else ring_at
    rings = runs[ring_at]
    part_at = _starts(rings[:, ROW], rings[:, MEMBER], rings[:, PART])
    parts = rings[part_at]
    row_sizes = np.bincount(members[:, 0], minlength=n_rows)
    first = np.cumsum(row_sizes) - row_sizes
    member_of_part = first[parts[:, ROW]] + parts[:, MEMBER]
    member_sizes = np.bincount(member_of_part, minlength=len(members))

    vertex = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])
    shape = vertex
    for sizes in (ring_sizes, _sizes(part_at, len(rings)), member_sizes):
        shape = pa.ListArray.from_arrays(_offsets(sizes), shape)
    names = pa.array([""] + [NAMES[c] for c in sorted(NAMES)])
    geom = pa.StructArray.from_arrays(
        [names.take(pa.array(members[:, 1])), shape], names=["type", "parts"])
    failed = np.zeros(n_rows, dtype=bool)
    failed[list(errors)] = True
    reasons = [errors.get(i) for i in range(n_rows)] if errors else pa.nulls(n_rows, pa.string())
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(_offsets(row_sizes), geom, mask=pa.array(failed)),
         pa.array(reasons, pa.string())],
        names=["members", "error"],
        mask=pa.array(null),
    )


def decode_batch(values: pa.Array) -> pa.Array:
    """``struct<members, error>`` for one batch of WKB values."""
    values = values.cast(pa.large_binary())
    n = len(values)
    null = values.is_null().to_numpy(zero_copy_only=False)
    _, offset_buffer, data_buffer = values.buffers()
    bounds = np.frombuffer(offset_buffer, np.int64)[values.offset:values.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    rows = np.flatnonzero(~null)
    starts, ends = bounds[:-1][rows], bounds[1:][rows]
    runs, members, covered = _plain_runs(data, rows, starts, ends)
    walk, errors = Walk(data), {}
    for i in np.flatnonzero(~covered):
        try:
            walk.value(int(rows[i]), int(starts[i]), int(ends[i]))
        except ValueError as reason:
            errors[int(rows[i])] = str(reason)
    runs.append(np.array(walk.runs, dtype=np.int64).reshape(-1, 8))
    members.append(np.array(walk.members, dtype=np.int64).reshape(-1, 2))
    return _assemble(data, np.concatenate(runs), np.concatenate(members), n, null, errors)
