"""Helpers of the training-data operators: numpy views of text columns, and hashes of words and windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from memloom.sources.scratch import cut, scratch, shared_dir

__all__ = ["CHUNK_BYTES", "chunks", "cover", "cut", "fields", "first_windows", "free_name", "levels", "mix", "plain_names", "row_hashes", "scratch", "shared_dir", "text_bytes", "window_hashes", "word_bounds", "word_hashes"]

#: Bytes of text that one numpy step handles; the arrays made from them stay below about 40 times this.
CHUNK_BYTES = 1 << 19

def fields(ddl: str) -> list[T.StructField]:
    """The fields of a DDL string (on the driver)."""
    return T.StructType.fromDDL(ddl).fields


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def plain_names(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns named column0_, column1_, ... and these names: names with dots, quotes or those that a
    result adds clash with nothing. ``toDF(*df.columns)`` gives the names back."""
    names = [f"column{k}_" for k in range(len(df.columns))]
    return df.toDF(*names), names


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows, without a copy; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, name: str, size: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``size`` bytes of text (one row at least) and at most ``rows`` rows, with that text
    and its offsets. Arrow's free memory goes back to the system after each batch."""
    data, offsets = text_bytes(batch.column(name))
    lo = 0
    while lo < len(batch):
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1))
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    pa.default_memory_pool().release_unused()


def word_bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each run of true values, runs cut at the rows' borders, and each row's first run
    (n + 1 numbers)."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes of a word that numpy hashes, eight at a time; a longer word is hashed as a whole by BLAKE2.
LONG_WORD = 128
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], "<u8")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salt(n: int) -> np.uint64:
    return np.uint64((n * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % (1 << 64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, the same in every process: eight bytes after another are added and mixed,
    so that neither the words' order of bytes nor a repeated pattern cancels out, and no Python object is made for a
    word of usual length."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + _salt(7))
    if not len(starts):
        return out
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    at = np.arange(len(starts))
    if int(size.max()) > LONG_WORD:
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
        at = np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(at):
        piece = np.ascontiguousarray(eights[starts[at] + done]).view("<u8")[:, 0] & _FIRST_BYTES[np.minimum(size[at] - done, 8)]
        out[at] = mix(out[at] * np.uint64(0x9E3779B97F4A7C15) + piece)
        done += 8
        at = at[size[at] > done]
    return out


def _both(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    return mix(left ^ mix(right + _salt(salt)))


def levels(words: np.ndarray, n: int, salt: int = 1) -> list[np.ndarray]:
    """Hashes of each 1, 2, 4, ... consecutive word hashes, up to n of them: each from the two halves, mixed anew."""
    out = [words]
    while 2 << (len(out) - 1) <= min(n, len(words)):
        half = 1 << (len(out) - 1)
        out.append(_both(out[-1][:-half], out[-1][half:], salt))
    return out


def window_hashes(words: np.ndarray, n: int, salt: int = 1) -> np.ndarray:
    """A 64-bit hash of each n consecutive word hashes (rows' borders are the caller's)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    own, count, at = levels(words, n, salt), len(words) - n + 1, 0
    total = np.full(count, _salt(n), np.uint64)
    for k in reversed(range(len(own))):
        if n >> k & 1:
            total = _both(total, own[k][at : at + count], salt)
            at += 1 << k
    return total


def row_hashes(words: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each row's sequence of word hashes: a sum over the words, each mixed with its place; first:
    rows' first words."""
    size = np.diff(first)
    place = (np.arange(len(words)) - np.repeat(first[:-1], size)).astype(np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words ^ mix(place + _salt(salt))), out=total[1:])
    return mix(total[first[1:]] - total[first[:-1]] + mix(size.astype(np.uint64) + _salt(salt)))


def first_windows(first: np.ndarray, n: int) -> np.ndarray:
    """True for each word index at which a window of n words of one row begins; first: rows' first words."""
    ok = np.zeros(int(first[-1]) + 1, np.int32)
    size = np.diff(first)
    lo, hi = first[:-1][size >= n], first[1:][size >= n] - n + 1
    np.add.at(ok, lo, 1)
    np.add.at(ok, hi, -1)
    return np.cumsum(ok[:-1]) > 0


def cover(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """True for each of ``size`` words inside a window of n words that begins at one of ``at``."""
    ok = np.zeros(size + 1, np.int32)
    np.add.at(ok, at, 1)
    np.add.at(ok, np.minimum(at + n, size), -1)
    return np.cumsum(ok[:-1]) > 0
