"""Texts in bounded portions, and sorted keys with counts in binary chunks that meet by shard.

A task counts what it has read in sorted numpy arrays and emits one row for each shard of a
portion: (shard, keys, counts), the keys as differences.  A shard's rows meet in one group, whose
size follows from the number of shards and not from the frequency of a key, as
each portion holds a key once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task handles at a time; a longer text is a portion of its own.
PORTION = 8_000_000
#: Bytes of text of the whole corpus for each shard, about.
SHARD_BYTES = 4_000_000


def portions(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PORTION) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as bytes (null: empty)."""
    for batch in batches:
        column = pc.fill_null(batch.column(text), "").cast(pa.large_binary())
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at), column.slice(at, to - at).to_pylist()
            at = to


def shard_bits(docs: DataFrame, text: str = "text") -> int:
    """The base-2 logarithm of the number of shards for these texts."""
    held = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(0, int(held // SHARD_BYTES).bit_length())


def mixed(keys: np.ndarray) -> np.ndarray:
    """Keys with their bits mixed, one to one."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(mixed_keys: np.ndarray, bits: int) -> np.ndarray:
    """The shard that the first bits name."""
    return (mixed_keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(mixed_keys), np.int64)


def pack(values: np.ndarray, ascending: bool = False, width: int = 8) -> bytes:
    """Whole numbers as planes of bytes, so that small ones compress; ascending ones as differences."""
    x = np.diff(values, prepend=values.dtype.type(0)) if ascending else values
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unpack(data: bytes, ascending: bool = False, width: int = 8) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()
    return np.cumsum(x, dtype=np.uint64) if ascending else x


CHUNKS = "shard int, kind int, keys binary, counts binary"


def chunks(shards: np.ndarray, keys: np.ndarray, *counts: np.ndarray, kind: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of CHUNKS for unique keys in any order; several counts for each key lie behind one another."""
    if not len(keys):
        return
    order = np.lexsort((keys, shards))
    shards, keys, counts = shards[order], keys[order], [c[order] for c in counts]
    starts = np.flatnonzero(np.diff(shards, prepend=-1))
    parts = list(zip(starts, [*starts[1:], len(shards)], strict=True))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(shards[starts].astype(np.int32)),
            pa.array(np.full(len(parts), kind, np.int32)),
            pa.array([pack(keys[a:b], True) for a, b in parts], pa.binary()),
            pa.array([b"".join(pack(c[a:b]) for c in counts) for a, b in parts], pa.binary()),
        ],
        names=["shard", "kind", "keys", "counts"],
    )


def summed(table: pa.Table, width: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted keys of a shard's chunks, and each of their counts summed."""
    every, counts = [], []
    for keys, held in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True):
        every.append(unpack(keys, True))
        counts.append(unpack(held).reshape(width, -1) if width == 1 else np.stack([unpack(held[i * len(held) // width : (i + 1) * len(held) // width]) for i in range(width)]))
    if not every:
        return np.empty(0, np.uint64), [np.empty(0, np.uint64)] * width
    keys, counts = np.concatenate(every), np.concatenate(counts, axis=1)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], [np.add.reduceat(c[order], starts) if len(keys) else c for c in counts]
