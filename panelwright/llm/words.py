"""Whole-column word splitting and hashing on Arrow buffers: numpy passes over bytes, no Python string per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer document is a pass of its own.
PASS_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]+`: every byte but ASCII white space.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a-z and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as string array without nulls (null reads as empty)."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col, "") if col.null_count else col


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it."""
    while name in df.columns:
        name += "_"
    return name


def carrying(docs: DataFrame, keep: list[str] | None, text_col: str) -> DataFrame:
    """``row``, a struct of the columns to keep (None: all), and the text as ``t`` where the row doesn't hold it."""
    keep = docs.columns if keep is None else keep
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    return docs.select(row) if text_col in keep else docs.select(row, F.col(f"`{text_col}`").alias("t"))


def carried_text(batch: pa.RecordBatch, text_col: str) -> pa.Array:
    if "t" in batch.schema.names:
        return text_column(batch, "t")
    col = pc.struct_field(batch.column(0), text_col)
    return pc.fill_null(col, "") if col.null_count else col


def passes(col: pa.Array, most: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) over consecutive rows of at most ``most`` bytes, or one longer row."""
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    n = len(col)
    if not n:
        return
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(o, o[lo] + most, "right")) - 1)
        yield lo, hi, raw[o[lo] : o[hi]], o[lo : hi + 1] - o[lo]
        lo = hi


def spans(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``kind`` bytes inside rows, and the number of runs before each row's start."""
    return mask_spans(kind[buf], offs)


def mask_spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a mask of bytes."""
    n = len(inside)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offs] = True
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1] | cut[1:n]
        last[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes at a time."""
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(buf) + 1, dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at, left = None, starts, size
    while len(at):
        piece = eight[at] & _KEEP[np.minimum(left, 8)]
        if live is None:
            out = mix(out ^ piece)
        else:
            out[live] = mix(out[live] ^ piece)
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    return out


def word_rows(counts_before: np.ndarray) -> np.ndarray:
    """The row (within the pass) of each word."""
    return np.repeat(np.arange(len(counts_before) - 1), np.diff(counts_before))
