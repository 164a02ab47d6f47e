"""Substring dedup by recompression: rounds name runs and pairs of tokens, so that equal substrings have the same
symbols in their interior; shared high-level symbols reveal long repeats, which are then verified on their words.

A name is a 64-bit hash of what it stands for, so all executors agree on it without asking each other: a round
needs no shuffle. With every symbol goes its context, the range of words that alone decide that it arises; a symbol
whose context lies inside a window occurs in every copy of the window. Each window of ``WINDOW`` words is filed
under one such symbol, the least by hash of its context, and under itself where it has none.

1. Scan: the distinct symbols that windows are filed under, counted over the corpus. One in about seven words.
2. Symbols that occur twice set a bit of a map of bounded size. Windows under other symbols are unique.
3. Scan: windows under a set bit, by a 128-bit hash of their words; the first place of each is found by a minimum
   that is combined before the shuffle, so that a passage in a third of all documents is one row for each task.
4. Scan: a window under a set bit that isn't the first of its kind covers words that are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.shared import chunks, cover, cut, fields, first_windows, free_name, levels, mix, plain_names, row_hashes, window_hashes, word_bounds, word_hashes

WINDOW = 20
ROUNDS = 2
#: Bytes of text that one numpy step handles.
STEP_BYTES = 1 << 19
#: Bits of the map of repeated symbols for each of them, and the least and most it has (128 MiB). A full map costs
#: time (windows are then compared that needn't be) and changes no result.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 30
#: Bytes of ranges of first places (flat arrays) that are broadcast to the last scan; beyond it they are joined to the
#: documents, which are then shuffled once.
BROADCAST_BYTES = 64 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def symbols(words: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Context borders (low, high) of the symbols after the rounds, in order; only of symbols whose context lies
    inside their row."""
    n = len(words)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    name, lo, hi = words, np.arange(n), np.arange(1, n + 1)
    for r in range(rounds):
        if len(name) < 2:
            break
        # Runs of one symbol become one; that a run ends where it does is known from its neighbours.
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (row[1:] != row[:-1])])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(name)))
        end = at + size
        left = np.where((at > 0) & (row[np.maximum(at - 1, 0)] == row[at]), lo[np.maximum(at - 1, 0)], first[row[at]] - 1)
        more = np.minimum(end, len(name) - 1)
        right = np.where((end < len(name)) & (row[more] == row[at]), hi[more], first[row[at] + 1] + 1)
        name = np.where(size > 1, mix(name[at] + mix(size.astype(np.uint64))), name[at])
        row, lo, hi = row[at], left, right
        # The names are dealt into two sides; a left one with a right one after it become a pair.
        side = (mix(name ^ np.uint64(0xA5A5 + r)) >> np.uint64(63)).astype(bool)
        follows = row[1:] == row[:-1]
        pair = np.append(~side[:-1] & side[1:] & follows, False)
        second = np.concatenate([[False], pair[:-1]])
        after = np.append(np.where(follows, hi[1:], first[row[:-1] + 1] + 1), first[row[-1] + 1] + 1)
        before = np.concatenate([[first[row[0]] - 1], np.where(follows, lo[:-1], first[row[1:]] - 1)])
        next_name = np.append(name[1:], np.uint64(0))
        name = np.where(pair, mix(name * _PAIR + next_name), name)
        hi = np.where(pair | ~side, after, hi)  # an unpaired left one needs its right neighbour
        lo = np.where(side & ~second, before, lo)
        keep = ~second
        name, row, lo, hi = name[keep], row[keep], lo[keep], hi[keep]
    inside = (lo >= first[row]) & (hi <= first[row + 1])
    return lo[inside], hi[inside]


def _span_hashes(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """A hash of the words of each range of at most n of them; ranges may overlap. A range is hashed by its first
    and its last 1, 2, 4, ... words, as many as cover it."""
    out, size = np.zeros(len(lo), np.uint64), hi - lo
    for k, own in enumerate(levels(words, n)):
        here = np.flatnonzero((size >= 1 << k) & (size < 2 << k))
        out[here] = mix(own[lo[here]] + mix(own[hi[here] - (1 << k)] ^ mix(size[here].astype(np.uint64))))
    return out


def filed(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of n words: where it begins, the number of the symbol it is filed under (its own number,
    from the count of symbols on, if it has none), and the key of that symbol."""
    at = np.flatnonzero(first_windows(first, n))
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    lo, hi = symbols(words, first)
    near = hi - lo <= n
    lo, hi = lo[near], hi[near]
    keys = _span_hashes(words, lo, hi, n)
    a, b = np.searchsorted(lo, at, "left"), np.searchsorted(hi, at + n, "right")
    count = np.maximum(b - a, 0)
    best = np.arange(len(keys))
    chosen = np.full(len(at), -1)
    step = 1
    while len(keys):  # the least key of a range, by ranges of 1, 2, 4, ...: the first of equal ones
        here = np.flatnonzero((count >= step) & (count < 2 * step))
        if len(here):
            x, y = best[a[here]], best[b[here] - step]
            chosen[here] = np.where(keys[y] < keys[x], y, x)
        if not (count >= 2 * step).any():
            break
        x, y = best[: len(best) - step], best[step:]
        best = np.where(keys[y] < keys[x], y, x)
        step *= 2
    none = chosen < 0
    own = ~window_hashes(words, n)[at[none]]
    out = np.zeros(len(at), np.uint64)
    out[~none] = keys[chosen[~none]]
    out[none] = own
    chosen[none] = len(keys) + at[none]
    return at, chosen, out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(~_SPACE[data], offsets)
    return starts, ends, first, word_hashes(data, starts, ends)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def repeated_symbols(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """The bit map of the symbols that occur more than once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in chunks(batch, text, STEP_BYTES):
                _, _, first, words = _words(data, offsets)
                _, chosen, keys = filed(words, first, n)
                _, one = np.unique(chosen, return_index=True)
                found, count = np.unique(keys[one], return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": _signed(found), "n": pa.array(count.astype(np.int64))})

    counted = cut(docs.select(text).mapInArrow(scan, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "substring-symbols")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * counted.count()).bit_length()))
    slot = F.col("key").bitwiseAND(F.lit(bits - 1))
    blocks = counted.select(F.shiftright(slot, 15).cast("int").alias("block"), slot.bitwiseAND(F.lit((1 << 15) - 1)).cast("int").alias("bit")).groupBy("block").agg(F.collect_set("bit").alias("bits"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bits in batch.column("bits"):
                own = np.zeros(1 << 15, bool)
                own[bits.values.to_numpy()] = True
                out.append(np.packbits(own).tobytes())
            yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "bits": pa.array(out, pa.binary())})

    packed = cut(blocks.mapInArrow(pack, "block int, bits binary"), "substring-map")
    whole = np.zeros(bits // 8, np.uint8)
    for row in packed.toLocalIterator():  # at most MOST_BITS / 8 bytes
        whole[row.block << 12 : (row.block + 1) << 12] = np.frombuffer(bytes(row.bits), np.uint8)
    return whole


def _is_set(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = (keys & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


class _Ranges:
    """Ranges of first places by document, in flat arrays: documents by id and mark, and where their ranges begin."""

    def __init__(self, rows: Iterator) -> None:
        parts = [[np.zeros(0, np.int64)] for _ in range(5)]
        while some := list(islice(rows, 10_000)):
            parts[0].append(np.array([r.id for r in some]))
            parts[1].append(np.array([r.mark for r in some]))
            parts[2].append(np.array([len(r.lows) for r in some]))
            parts[3].append(np.concatenate([np.array(r.lows, np.int64) for r in some]))
            parts[4].append(np.concatenate([np.array(r.highs, np.int64) for r in some]))
        ids, marks, sizes, self.lows, self.highs = map(np.concatenate, parts)
        ends = np.cumsum(sizes)
        order = np.argsort(ids, kind="stable")
        self.ids, self.marks, self.begins, self.ends = ids[order], marks[order], (ends - sizes)[order], ends[order]

    def of(self, doc: int, mark: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.ids, doc, "left"), np.searchsorted(self.ids, doc, "right")
        for k in range(int(a), int(b)):
            if self.marks[k] == mark:
                own = slice(self.begins[k], self.ends[k])
                return self.lows[own], self.highs[own]
        return self.lows[:0], self.highs[:0]


def _ids(column: pa.Array) -> np.ndarray:
    """Document ids as 64-bit numbers; null comes after all."""
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def _first_places(docs: DataFrame, table, text: str, doc_id: str, n: int) -> DataFrame:
    """(id, mark, lows, highs): per document the ranges of window starts that are the first of their kind, among
    windows whose symbol repeats. mark: 31 bits of the hash of the document's words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, text, STEP_BYTES):
                _, _, first, words = _words(data, offsets)
                at, _, keys = filed(words, first, n)
                at = at[_is_set(table.value, keys)]
                one, two = window_hashes(words, n)[at], window_hashes(words, n, 2)[at]
                row = np.searchsorted(first, at, "right") - 1
                ids = _ids(part.column(doc_id))[row]
                order = np.lexsort((at - first[row], ids, two, one))  # in this chunk one row for each kind, its first
                lead = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]) if len(at) else np.zeros(0, bool)
                take = order[lead]
                mark = (row_hashes(words, first, 1) >> np.uint64(33)).astype(np.int64)
                place = (mark[row] << 32) | (at - first[row])
                yield pa.RecordBatch.from_pydict({"one": _signed(one[take]), "two": _signed(two[take]), "id": pa.array(ids[take]), "place": pa.array(place[take])})

    found = docs.select(doc_id, text).mapInArrow(scan, "one bigint, two bigint, id bigint, place bigint")
    lead = found.groupBy("one", "two").agg(F.min("id").alias("id"), F.min_by("place", "id").alias("place"))
    by_row = lead.groupBy("id", F.shiftright("place", 32).alias("mark")).agg(F.sort_array(F.collect_list(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("at"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = [], []
            for value in batch.column("at"):
                at = value.values.to_numpy()
                new = np.flatnonzero(np.diff(at) > 1)
                lows.append(at[np.concatenate([[0], new + 1])].tolist())
                highs.append((at[np.append(new, len(at) - 1)] + 1).tolist())
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "mark": batch.column("mark"), "lows": pa.array(lows, kind), "highs": pa.array(highs, kind)})

    return cut(by_row.mapInArrow(ranges, "id bigint, mark bigint, lows array<bigint>, highs array<bigint>"), "substring-first")


def _removed(part: pa.RecordBatch, data, offsets, table: np.ndarray, doc_id: str, n: int, ranges_of) -> tuple:
    """Words of a chunk and which of them are removed."""
    starts, ends, first, words = _words(data, offsets)
    at, _, keys = filed(words, first, n)
    at = at[_is_set(table, keys)]
    row = np.searchsorted(first, at, "right") - 1
    ids, mark = _ids(part.column(doc_id)), (row_hashes(words, first, 1) >> np.uint64(33)).astype(np.int64)
    later = np.ones(len(at), bool)
    for r in np.unique(row).tolist():
        lows, highs = ranges_of(r, int(ids[r]), int(mark[r]))
        a, b = np.searchsorted(row, [r, r + 1])
        own = at[a:b] - first[r]
        k = np.searchsorted(lows, own, "right") - 1
        later[a:b] = (k < 0) | (own >= highs[np.maximum(k, 0)]) if len(lows) else True
    return starts, ends, first, cover(at[later], n, len(words))


def _apply(docs: DataFrame, text: str, doc_id: str, n: int, names: list[str], more: list[T.StructField], result) -> DataFrame:
    """``names`` and what ``result(part, raw, offsets, starts, ends, first, removed)`` makes of each chunk."""
    sc = docs.sparkSession.sparkContext
    source = docs.select(*dict.fromkeys([*names, doc_id, text]))
    table = sc.broadcast(repeated_symbols(docs, text, n))
    places = _first_places(docs, table, text, doc_id, n)
    size = places.agg(F.sum(F.size("lows") * 16 + 24)).first()[0] or 0
    empty = np.zeros(0, np.int64)
    schema = T.StructType([*(docs.schema[c] for c in names), *more])
    if size <= BROADCAST_BYTES:
        shared = sc.broadcast(_Ranges(iter(places.toLocalIterator())))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offsets in chunks(batch, text, STEP_BYTES):
                    got = _removed(part, data, offsets, table.value, doc_id, n, lambda r, i, m: shared.value.of(i, m))
                    yield result(part, data, offsets, *got)

        return source.mapInArrow(scan, schema)

    ident = free_name(source, "ident")
    packed = places.groupBy(F.col("id").alias(ident)).agg(F.collect_list(F.struct("mark", "lows", "highs")).alias(ident + "_ranges"))
    joined = source.join(packed, F.coalesce(source[doc_id].cast("bigint"), F.lit(int(np.iinfo(np.int64).max))) == packed[ident], "left")

    def scan_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, text, STEP_BYTES):
                column = part.column(ident + "_ranges")

                def ranges_of(r, i, m, column=column):
                    own = next((x for x in column[r].as_py() or [] if x["mark"] == m), None)
                    return (np.array(own["lows"]), np.array(own["highs"])) if own else (empty, empty)

                yield result(part, data, offsets, *_removed(part, data, offsets, table.value, doc_id, n, ranges_of))

    return joined.mapInArrow(scan_joined, schema)


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, gone: np.ndarray) -> Iterator[bytes]:
    """Each row's kept words, joined by one space."""
    step = np.zeros(len(data) + 1, np.int8)
    step[starts[~gone]] += 1
    step[ends[~gone]] -= 1
    raw = np.where(np.cumsum(step[:-1], dtype=np.int8) > 0, data, 32).astype(np.uint8)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        yield b" ".join(w for w in raw[starts[lo] : ends[hi - 1]].tobytes().split(b" ") if w) if hi > lo else b""


def report(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space).

    Null and empty texts have no words; texts of fewer than n words lose none. Documents come in the order of
    their ids, null ids last; of rows with one id neither is earlier, so none of them loses a word to another.
    Windows are judged on the input."""

    def result(part, data, offsets, starts, ends, first, gone):
        total = np.concatenate([[0], np.cumsum(gone)])
        kept = [hashlib.sha256(x).hexdigest() for x in _kept(data, starts, ends, first, gone)]
        return pa.RecordBatch.from_pydict({doc_id: part.column(doc_id), "n_words": pa.array(np.diff(first)), "n_removed": pa.array(np.diff(total[first])), "kept_sha256": pa.array(kept, pa.string())})

    return _apply(docs, text, doc_id, n, [doc_id], fields("n_words bigint, n_removed bigint, kept_sha256 string"), result)


def remove(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n: int = WINDOW) -> DataFrame:
    """The documents with every word removed that a later copy of a window covers. Texts that lose nothing stay
    byte for byte; others are their kept words, joined by one space. n_chars, where it is, follows."""

    plain, names = plain_names(docs)
    place = {c.lower(): n for c, n in zip(docs.columns, names)}
    own, sizes = place[text.lower()], place.get("n_chars")

    def result(part, data, offsets, starts, ends, first, gone):
        total = np.concatenate([[0], np.cumsum(gone)])
        hit = np.diff(total[first]) > 0
        columns = {c: part.column(c) for c in names}
        if hit.any():
            old = columns[own].to_pylist()
            new = [k.decode() if h else t for k, h, t in zip(_kept(data, starts, ends, first, gone), hit, old)]
            columns[own] = pa.array(new, columns[own].type)
            if sizes is not None:
                columns[sizes] = pa.array([len(t) if h else c for t, h, c in zip(new, hit, columns[sizes].to_pylist())], columns[sizes].type)
        return pa.RecordBatch.from_pydict(columns)

    return _apply(plain, own, place[doc_id.lower()], n, names, [], result).toDF(*docs.columns)
