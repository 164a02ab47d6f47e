"""Byte-level BPE encoding and decoding.

Spark higher-order functions fold the ranked merges over the byte arrays of distinct words, with a literal rank
map: that makes a dictionary of the frequent words, bounded in size. One scan then encodes the documents: words of
the dictionary are looked up, others go through the same fold in place. Higher-order functions decode: they look up
the binary pieces of the ids in a literal array and concatenate them. (Folding every word of every document with
higher-order functions is right as well, see ``fold``, but takes too much time; the README has the figures.)
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.shared import cut, plain_names

#: Words of the dictionary, and documents whose words are counted for it. Both only bound its size: no result
#: depends on them.
DICTIONARY_WORDS = 1 << 17
SAMPLE_DOCUMENTS = 20_000
#: Longer words are folded in place with a heap.
DICTIONARY_BYTES = 48
NONE = 1 << 20
#: Characters of the longest word whose ids a worker remembers.
LONG_WORD = 256


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id * 65536 + right id) of two tokens whose concatenation is a token -> its rank."""
    out = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                out[a << 16 | b] = rank
    return out


#: Texts whose characters are all below this are split by ``re``, whose classes are listed from those of ``regex``.
LISTED = 0x250


def splitter(pattern: str):
    """A function that gives the matches of ``pattern`` in a text, as :mod:`regex` finds them."""
    import regex

    find, fast = regex.compile(pattern).findall, _listed(pattern)
    if fast is None:
        return find
    beyond = re.compile(f"[{chr(LISTED)}-{chr(0x10FFFF)}]").search
    return lambda text: find(text) if beyond(text) else fast(text)


def _listed(pattern: str):
    """The pattern for ``re``, right for characters below ``LISTED``: its classes as ranges. None where it uses
    anything that isn't sure to mean the same there."""
    import regex

    ranges = {}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        hits = [k for k in range(LISTED) if regex.fullmatch(kind, chr(k))]
        ranges[kind] = "".join(f"\\u{k:04x}" for k in hits)
    out, inside, at = [], False, 0
    while at < len(pattern):
        kind = next((k for k in ranges if pattern.startswith(k, at)), None)
        if kind:
            out.append(ranges[kind] if inside else f"[{ranges[kind]}]")
            at += len(kind)
        elif pattern.startswith(r"\S", at) and not inside:
            out.append(f"[^{ranges[chr(92) + 's']}]")
            at += 2
        elif pattern[at] == "\\" or pattern.startswith("(?", at) and pattern[at : at + 3] not in ("(?!", "(?=", "(?:") or inside and pattern[at] == "[":
            return None
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at])
            at += 1
    return re.compile("".join(out)).findall


def fold_word(word: bytes, ranks: dict[bytes, int], merges: dict[int, int], single: list[int]) -> list[int]:
    """The ids of one word: the word itself if it is a token, else its bytes with the adjacent pair of lowest rank
    merged again and again, the first of equal ones."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    ids = [single[b] for b in word]
    get = merges.get
    if len(ids) > 200:
        return _fold_long(ids, get)
    order = [get(a << 16 | b, NONE) for a, b in zip(ids, ids[1:])]
    while order:
        rank = min(order)
        if rank == NONE:
            break
        k = order.index(rank)
        ids[k : k + 2] = [rank]
        del order[k]
        if k:
            order[k - 1] = get(ids[k - 1] << 16 | rank, NONE)
        if k < len(order):
            order[k] = get(rank << 16 | ids[k + 1], NONE)
    return ids


def _fold_long(ids: list[int], get) -> list[int]:
    """The same with a heap and a linked list, for words of thousands of bytes."""
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get(ids[k] << 16 | ids[k + 1], NONE)) != NONE]
    heapq.heapify(heap)
    while heap:
        rank, k, a, b = heapq.heappop(heap)
        right = after[k]
        if not alive[k] or ids[k] != a or right >= n or ids[right] != b:
            continue
        ids[k], alive[right] = rank, False
        after[k] = after[right]
        if after[k] < n:
            before[after[k]] = k
            r = get(rank << 16 | ids[after[k]], NONE)
            if r != NONE:
                heapq.heappush(heap, (r, k, rank, ids[after[k]]))
        if before[k] >= 0:
            r = get(ids[before[k]] << 16 | rank, NONE)
            if r != NONE:
                heapq.heappush(heap, (r, before[k], ids[before[k]], rank))
    return [x for x, live in zip(ids, alive) if live]


# The literal rank map: a table in which each pair stands in one of two places, so that a lookup reads two elements.
_ONE, _TWO, _SHIFT = 1_000_003, 998_244_353, 11


def _places(pair: int, size: int) -> tuple[int, int]:
    return (pair * _ONE >> _SHIFT) % size, (pair * _TWO >> _SHIFT) % size


def rank_table(merges: dict[int, int]) -> list[int]:
    """pair * 65536 + rank in one of the pair's two places, -1 elsewhere."""
    size = max(1024, 5 * len(merges) // 2 | 1)
    table = [-1] * size
    for pair, rank in merges.items():
        entry, at = pair << 16 | rank, _places(pair, size)[0]
        for _ in range(500):
            entry, table[at] = table[at], entry
            if entry < 0:
                break
            one, two = _places(entry >> 16, size)
            at = two if at == one else one
        else:
            raise ValueError("the rank table is too full")
    return table


def fold(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of a binary column's words that aren't tokens themselves, by higher-order functions alone: an
    aggregate over the word's positions whose state is the array of ids so far."""
    values = rank_table(merges_of(ranks))
    size = len(values)
    literal = F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    single = F.array(*[F.lit(ranks[bytes((b,))]) for b in range(256)])
    digits = F.hex(word)

    def rank(table: Column, pair: Column) -> Column:
        one = F.element_at(table, (F.shiftright(pair * F.lit(_ONE), _SHIFT) % size + 1).cast("int"))
        two = F.element_at(table, (F.shiftright(pair * F.lit(_TWO), _SHIFT) % size + 1).cast("int"))
        low = lambda e: e.bitwiseAND(F.lit(65535)).cast("int")
        return F.when(F.shiftright(one, 16) == pair, low(one)).when(F.shiftright(two, 16) == pair, low(two)).otherwise(F.lit(NONE))

    def merge(table: Column, ids: Column) -> Column:
        order = F.zip_with(F.slice(ids, 1, F.size(ids) - 1), F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), lambda a, b: rank(table, a.cast("bigint") * 65536 + b))
        state = F.transform(F.array(order), lambda o: F.struct(o.alias("o"), F.array_min(o).alias("least")))
        placed = F.transform(state, lambda s: F.struct(s.least.alias("least"), F.array_position(s.o, s.least).cast("int").alias("k")))
        merged = F.transform(placed, lambda p: F.when(F.coalesce(p.least, F.lit(NONE)) < NONE, F.concat(F.slice(ids, 1, p.k - 1), F.array(p.least), F.slice(ids, p.k + 2, F.size(ids)))).otherwise(ids))
        return merged[0]

    count = F.octet_length(word)
    start = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.element_at(single, (F.conv(F.substring(digits, k * 2 + 1, 2), 16, 10).cast("int") + 1)))
    steps = F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
    # The table is named once: plans print their literals.
    folded = F.transform(F.array(literal), lambda table: F.aggregate(steps, start, lambda ids, _: merge(table, ids)))[0]
    return F.when(count > 0, folded).otherwise(F.array().cast("array<int>"))


def dictionary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text: str = "text", doc_id: str = "doc_id") -> pa.Table:
    """word and ids: the ids of the frequent words of a bounded sample of documents, folded by :func:`fold`."""
    spark = docs.sparkSession
    total = docs.count()
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, total))
    sample = docs.where(F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(text)

    shared = spark.sparkContext.broadcast(ranks)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = splitter(pattern)
        for batch in batches:
            seen: Counter = Counter()
            for value in batch.column(text):
                seen.update(w for w in find(value.as_py() or "") if len(w) <= DICTIONARY_BYTES)
            own = [w.encode() for w in seen]
            yield pa.RecordBatch.from_pydict({"word": pa.array(own, pa.binary()), "n": pa.array(list(seen.values()), pa.int64()), "rank": pa.array([shared.value.get(w) for w in own], pa.int32())})

    counted = sample.mapInArrow(words, "word binary, n bigint, rank int").groupBy("word").agg(F.sum("n").alias("n"), F.max("rank").alias("rank"))
    frequent = counted.where(F.octet_length("word") <= DICTIONARY_BYTES).orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS)
    known = cut(frequent.repartition(max(8, spark.sparkContext.defaultParallelism * 2), "word"), "bpe-words")
    folded = cut(known.select("word", F.when(F.col("rank").isNotNull(), F.array("rank")).otherwise(fold(F.col("word"), ranks)).alias("ids")), "bpe-dictionary")
    out = pa.Table.from_batches([pa.RecordBatch.from_pydict({"word": pa.array([bytes(r.word).decode() for r in rows], pa.string()), "ids": pa.array([list(r.ids) for r in rows], pa.list_(pa.int32()))}) for rows in _few(folded.toLocalIterator())], pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))]))
    shared.unpersist()
    return out


def _few(rows, n: int = 5_000):
    rows = iter(rows)
    while some := list(islice(rows, n)):
        yield some


def encode(docs: DataFrame, *, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), to: str = "ids") -> DataFrame:
    """``keep`` and the token ids of every whole text. Null and empty texts have none."""
    names = list(keep)
    ranks = ranks_of(path)
    held = docs.sparkSession.sparkContext.broadcast((dictionary(docs, ranks, pattern, text=text, doc_id=doc_id), ranks))
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(to, T.ArrayType(T.IntegerType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, find = _Words(*held.value), splitter(pattern)
        for batch in (b.slice(k, 500) for b in batches for k in range(0, len(b), 500)):
            ids = [b"".join(map(own.__getitem__, find(value.as_py() or ""))) for value in batch.column(text)]
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            column = pa.ListArray.from_arrays(at, np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), column], schema=pa.schema([*(batch.schema.field(c) for c in names), (to, pa.list_(pa.int32()))]))

    return docs.select(*dict.fromkeys([*names, doc_id, text])).mapInArrow(scan, schema)


class _Words(dict):
    """Words and their ids as the bytes of 32-bit numbers: those of the dictionary, and of others the last ones."""

    def __init__(self, words: pa.Table, ranks: dict[bytes, int]) -> None:
        for part in words.to_batches(4_096):
            ids, at = part.column(1).flatten().to_numpy().astype("<i4"), np.concatenate([[0], np.cumsum(pc.list_value_length(part.column(1)).to_numpy())])
            for k, word in enumerate(part.column(0).to_pylist()):
                self[word] = ids[at[k] : at[k + 1]].tobytes()
        self.ranks, self.merges, self.single, self.rest = ranks, merges_of(ranks), [ranks[bytes((b,))] for b in range(256)], {}

    def __missing__(self, word: str) -> bytes:
        got = self.rest.get(word)
        if got is None:
            got = array("i", fold_word(word.encode(), self.ranks, self.merges, self.single)).tobytes()
            if len(self.rest) >= 1 << 15:
                self.rest.clear()
            if len(word) <= LONG_WORD:
                self.rest[word] = got
        return got


def decode(df: DataFrame, *, path: str, ids: str = "ids", to: str = "bytes") -> DataFrame:
    """``df`` with the concatenated binary pieces of its ids; null for null ids, and an id that isn't in the
    vocabulary stands for no bytes. By higher-order functions: pieces are looked up in a literal array."""
    ranks = ranks_of(path)
    pieces = [""] * (max(ranks.values(), default=0) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    held = F.transform(F.filter(ids, lambda x: (x >= 0) & (x < len(pieces))), lambda x: F.element_at(table, x + 1))
    return df.withColumn(to, F.unhex(F.array_join(held, "")))


def report(docs: DataFrame, *, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The query's digest columns: the ids of every whole text, and the bytes that decoding the ids gives."""
    got = decode(encode(docs, path=path, pattern=pattern, text=text, doc_id=doc_id, keep=(doc_id,), to="ids_"), path=path, ids="ids_", to="bytes_")
    return got.select(doc_id, F.size("ids_").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids_").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("bytes_", 256).alias("decoded_sha256"))


def with_ids(docs: DataFrame, *, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", to: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the ids."""
    if to.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {to} already")
    plain, names = plain_names(docs)
    place = {c.lower(): n for c, n in zip(docs.columns, names)}
    return encode(plain, path=path, pattern=pattern, text=place[text.lower()], doc_id=place[doc_id.lower()], keep=tuple(names), to="ids_").toDF(*docs.columns, to)
