"""Benchmark decontamination: a broadcast hash set of the normalised n-grams of the test items is held against
every window of the training documents; hits are verified on their bytes; spans or documents can be removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.shared import chunks, cut, fields, first_windows, plain_names, text_bytes, window_hashes, word_bounds, word_hashes

WINDOW = 8
MIN_ITEMS = 2
#: Text of the items, in bytes, that is held against the documents in one broadcast (about five times as much with
#: its hashes and places); a larger test set is cut into blocks of items of about this size and each block takes its
#: turn.
BLOCK_BYTES = 8 << 20

#: A byte of a word as its lower-case form, 0 for all other bytes. Every byte of a character above U+007F is one.
_FORM = np.zeros(256, np.uint8)
_FORM[0x30:0x3A] = np.arange(0x30, 0x3A)
_FORM[0x41:0x5B] = np.arange(0x61, 0x7B)
_FORM[0x61:0x7B] = np.arange(0x61, 0x7B)
_FORM[0x80:] = np.arange(0x80, 0x100)

_BITS = 1 << 22
_RANGES = "array<struct<lo:bigint,hi:bigint>>"


class _Set:
    """The windows of one block of items: the items' words in one buffer, joined by single spaces, and for each
    length of windows their sorted hashes, places in the buffer and items, behind a bit map."""

    def __init__(self, rows: list[tuple[str, str]], n: int) -> None:
        self.ids = [r[0] for r in rows]
        raw, offsets = text_bytes(pa.array([r[1] for r in rows], pa.large_string()))
        form = _FORM[raw]
        starts, ends, first = word_bounds(form != 0, offsets)
        size = ends - starts
        at = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int64)  # where each word begins in the buffer
        text = np.full(int(at[-1]), 32, np.uint8)
        inside = np.ones(len(text), bool)
        inside[at[1:] - 1] = False
        text[inside] = form[form != 0]
        self.text, words, count = text.tobytes(), word_hashes(form, starts, ends), np.diff(first)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for length in np.unique(np.minimum(count[count > 0], n)).tolist():
            begins = np.flatnonzero(first_windows(first, n)) if length == n else first[:-1][count == length]
            hashes = window_hashes(words, length)[begins]
            order = np.argsort(hashes, kind="stable")
            hashes, begins = hashes[order], begins[order]
            bits = np.zeros(_BITS, bool)
            bits[(hashes & np.uint64(_BITS - 1)).astype(np.int64)] = True
            item = (np.searchsorted(first, begins, "right") - 1).astype(np.int32)
            self.by_length[length] = hashes, bits, at[begins].astype(np.int32), (at[begins + length] - 1).astype(np.int32), item

    def items_of(self, length: int, found: int, window: bytes) -> set[str]:
        """The items that hold the window, whose hash is ``found``: its bytes are compared."""
        hashes, _, lo, hi, item = self.by_length[length]
        a, b = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
        return {self.ids[item[k]] for k in range(int(a), int(b)) if self.text[lo[k] : hi[k]] == window}


def _scan(batches: Iterator[pa.RecordBatch], text: str, keep: list[str], n: int, block: _Set, spans: bool) -> Iterator[pa.RecordBatch]:
    """For each row: words, hit words, items, and (if spans) the byte ranges of hit runs."""
    for batch in batches:
        for part, raw, offsets in chunks(batch, text):
            form = _FORM[raw]
            starts, ends, first = word_bounds(form != 0, offsets)
            words = word_hashes(form, starts, ends)
            hit, items = np.zeros(len(words) + 1, np.int32), [set() for _ in range(len(part))]
            for size, (known, bits, *_) in block.by_length.items():
                found = window_hashes(words, size)
                at = np.flatnonzero(bits[(found & np.uint64(_BITS - 1)).astype(np.int64)])
                if len(at):
                    at = at[first_windows(first, size)[at] & (known[np.minimum(np.searchsorted(known, found[at]), len(known) - 1)] == found[at])]
                rows = np.searchsorted(first, at, "right") - 1
                for k, row in zip(at.tolist(), rows.tolist()):
                    own = block.items_of(size, found[k], b" ".join(form[starts[j] : ends[j]].tobytes() for j in range(k, k + size)))
                    if own:  # the words themselves are equal, not only their hashes
                        items[row] |= own
                        hit[k] += 1
                        hit[k + size] -= 1
            inside = np.cumsum(hit[:-1]) > 0
            n_hit = np.diff(np.concatenate([[0], np.cumsum(inside)])[first])
            out = {c: part.column(c) for c in keep}
            out |= {"n_words": pa.array(np.diff(first)), "n_hit": pa.array(n_hit), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
            if spans:
                runs = word_bounds(inside, first)
                lo, hi = starts[runs[0]], ends[runs[1] - 1] if len(runs[1]) else runs[1]
                pieces = []
                for r in range(len(part)):
                    own = slice(runs[2][r], runs[2][r + 1])
                    pieces.append([{"lo": int(a - offsets[r]), "hi": int(b - offsets[r])} for a, b in zip(lo[own], hi[own])])
                out["spans"] = pa.array(pieces, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
            yield pa.RecordBatch.from_pydict(out)


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))


def _block_count(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> int:
    """One block where the whole test set is below the bound; else so many that each holds about half of it."""
    total = int(_items(benchmark, item, text).agg(F.sum(F.octet_length("t"))).first()[0] or 0)
    return 1 if total <= block_bytes else 2 * -(-total // block_bytes)


def _block(benchmark: DataFrame, item: str, text: str, k: int, count: int) -> list[tuple[str, str]]:
    rows = _items(benchmark, item, text)
    rows = rows if count == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k)
    return [(r.i, r.t) for r in rows.toLocalIterator()]


def hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", n: int = WINDOW, spans: bool = False, block_bytes: int = BLOCK_BYTES, then=None) -> DataFrame:
    """Per document: ``keep``, n_words, n_hit, items (sorted ids of the items with occurring windows) and, with
    ``spans``, the byte ranges of runs of hit words.

    Null and empty texts have no words and no hits. Items with null id or text are no items; an item of fewer
    words than n is one window; equal windows of several items count for each. Repeated documents each give a
    row. Documents are never shuffled. A test set above ``block_bytes`` is scanned in blocks: the row then
    passes through one scan for each block, which carries the ranges of hits so far. ``then``, if given, is a
    function of the resulting batches, run in the same worker, and the schema of what it yields.
    """
    schema = [docs.schema[c] for c in keep]
    more = fields("n_words bigint, n_hit bigint, items array<string>" + f", spans {_RANGES}" * spans)
    sc, out = docs.sparkSession.sparkContext, None
    source = docs.select(*dict.fromkeys([*keep, text]))
    count = _block_count(benchmark, item, item_text, block_bytes)
    for k in range(count):
        shared, names = sc.broadcast(_Set(_block(benchmark, item, item_text, k, count), n)), list(keep)

        def scan(batches, shared=shared, names=names):
            return _scan(batches, text, names, n, shared.value, spans or count > 1)

        if count == 1:
            return source.mapInArrow(lambda batches: then[0](scan(batches)), then[1]) if then else source.mapInArrow(scan, T.StructType([*schema, *more]))
        # written after each block, so that no worker holds two of them and the driver lets each go
        out = cut(_merge(out if out is not None else source, scan, text, keep, schema), "decontam-block")
        shared.destroy()
    done = _finish(out, text, keep, schema, more)
    return done.mapInArrow(*then) if then else done


def _merge(df: DataFrame, scan, text: str, keep: tuple[str, ...], schema: list) -> DataFrame:
    """One more block: its items and ranges are appended to those that the row carries."""
    own = [c for c in ("items_", "spans_") if c in df.columns]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, at = batch.select([c for c in batch.schema.names if c not in own]), 0
            for got in scan(iter([base])):
                part = batch.slice(at, len(got))
                at += len(got)
                items, ranges = got.column("items").to_pylist(), got.column("spans").to_pylist()
                if own:
                    items = [a + b for a, b in zip(part.column("items_").to_pylist(), items)]
                    ranges = [a + b for a, b in zip(part.column("spans_").to_pylist(), ranges)]
                out = {c: part.column(c) for c in base.schema.names}
                yield pa.RecordBatch.from_pydict(out | {"items_": pa.array(items, pa.list_(pa.string())), "spans_": pa.array(ranges, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))})

    plain = [df.schema[c] for c in df.columns if c not in own]
    return df.mapInArrow(step, T.StructType([*plain, *fields(f"items_ array<string>, spans_ {_RANGES}")]))


def _finish(df: DataFrame, text: str, keep: tuple[str, ...], schema: list, more: list) -> DataFrame:
    """Counts over the ranges of all blocks, which may overlap."""
    names, spans = list(keep), any(f.name == "spans" for f in more)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in chunks(batch, text):
                starts, _, first = word_bounds(_FORM[raw] != 0, offsets)
                counts, joined = [], []
                for r, ranges in enumerate(part.column("spans_").to_pylist()):
                    own, runs = starts[first[r] : first[r + 1]] - offsets[r], []
                    for lo, hi in sorted((x["lo"], x["hi"]) for x in ranges):
                        if runs and lo <= runs[-1]["hi"]:
                            runs[-1]["hi"] = max(runs[-1]["hi"], hi)
                        else:
                            runs.append({"lo": lo, "hi": hi})
                    counts.append(sum(int(np.searchsorted(own, x["hi"]) - np.searchsorted(own, x["lo"])) for x in runs))
                    joined.append(runs)
                out = {c: part.column(c) for c in names} | {"n_words": pa.array(np.diff(first)), "n_hit": pa.array(counts, pa.int64()), "items": pa.array([sorted(set(x)) for x in part.column("items_").to_pylist()], pa.list_(pa.string()))}
                if spans:
                    out["spans"] = pa.array(joined, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(step, T.StructType([*schema, *more]))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The query's digest columns over :func:`hits`."""
    got = hits(docs, benchmark, **options)
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= MIN_ITEMS).alias("contaminated"),
    )


def _without(text: str | None, spans: list[dict]) -> str | None:
    """The text without the byte ranges; each leaves one space."""
    if not spans:
        return text
    raw, out, at = text.encode(), [], 0
    for x in spans:
        out.append(raw[at : x["lo"]])
        at = x["hi"]
    return b" ".join(p.strip(b" ") for p in [*out, raw[at:]]).strip().decode()


def remove(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", min_items: int = MIN_ITEMS, **options) -> DataFrame:
    """The documents with as few as ``min_items`` test items go; from the others, hit words are cut out and
    each cut leaves one space. Columns stay; rows without a hit stay byte for byte. n_chars, where there is
    such a column, follows the text of a row that was cut."""
    plain, names = plain_names(docs)
    place = {c.lower(): n for c, n in zip(docs.columns, names)}
    own, sizes = place[text.lower()], place.get("n_chars")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.less(pc.list_value_length(batch.column("items")), min_items))
            spans = batch.column("spans").to_pylist()
            columns = {c: batch.column(c) for c in names}
            if any(spans):
                fixed = [_without(t, s) for t, s in zip(columns[own].to_pylist(), spans)]
                columns[own] = pa.array(fixed, columns[own].type)
                if sizes is not None:
                    columns[sizes] = pa.array([len(f) if s else c for f, s, c in zip(fixed, spans, columns[sizes].to_pylist())], columns[sizes].type)
            yield pa.RecordBatch.from_pydict(columns)

    return hits(plain, benchmark, text=own, keep=tuple(names), spans=True, then=(clean, plain.schema), **options).toDF(*docs.columns)
