"""Columns of numbers as compressed blocks, which tasks send each other by slot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that carry blocks: the slot they go to, what they hold, the block.
BLOCK = "slot int, kind int, block binary"

_OPTIONS = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_OPTIONS) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(block: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(block).read_next_batch()


def first_of(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each element the least value of its group; groups are neighbours."""
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else []
    if not len(starts):
        return values
    return np.repeat(np.minimum.reduceat(values, starts), np.diff(np.append(starts, len(groups))))


def slots_of(number: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each slot in ``values`` the places that have it, in their order."""
    if not len(values):
        return
    order = np.argsort(values, kind="stable")
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(values[order]) != 0]))
    for begin, end in zip(bounds, np.append(bounds[1:], len(order)), strict=True):
        yield int(values[order[begin]]), number[order[begin:end]]


def block_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    types = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["slot", "kind", "block"]
    )
