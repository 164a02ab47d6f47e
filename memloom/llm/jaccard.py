"""N-gram Jaccard join by chosen paths: sets of word n-grams are split recursively on sampled shared n-grams, small
buckets are compared by brute force, and the runs are repeated until the target share of pairs found.

1. Each text becomes the set of its n-gram hashes; the smallest ``POOL`` of them are its pool, a sample that texts
   choose alike. Equal texts are one from here on.
2. A run chooses one n-gram of every pool by hash; all runs are the smallest n-grams of the pool and share one
   shuffle. Texts that chose the same n-gram meet in its bucket; a bucket of one needs no pool.
3. A large bucket first ties its texts to one pivot: what is nearly the pivot needs no other comparison here,
   since by the triangle inequality of the Jaccard distance all its partners in the bucket are tied to the pivot
   as well; nor does a bucket that is tied to it as a whole. The rest is split by further n-grams of the pools,
   while that makes large buckets fewer. What is large then is compared in blocks, so nothing is capped.
4. Brute force in buckets compares pools and ties what may be similar; ties make candidate clusters, and every
   pair within a cluster is verified on the whole sets, large clusters in pairs of blocks. Only counts and ties
   leave a task, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.shared import chunks, cut, fields, free_name, plain_names, row_hashes, window_hashes, word_bounds, word_hashes
from memloom.operators.components import connected_components

WORDS, SIMILAR = 5, 0.8
POOL = 80
#: A run meets a pair of similarity s with a chance of about 1 - exp(-s / (1 - s / 2) / 1.25) or more; so many runs
#: miss a pair of 0.8 with a chance of exp(-0.8 * runs).
FOUND = 0.9995
#: N-grams that a member of a large bucket chooses for the next split. A pair shares 0.67 to 0.8 of its pools, so of
#: one chosen n-gram each split would lose a share; of two it keeps more than one on average, and what ten paths lose
#: stays below 1 - FOUND at any depth. Splits go on while each leaves less than this share of the rows in large
#: buckets, so many times at most.
BRANCHES, SHRINKS, DEPTH = 2, 0.5, 8
BUCKET = 512
#: Similarity of pools from which two texts are tied; near enough to the pivot to need nothing else.
TIE, ABSORB = 0.35, 0.8
#: Texts of a cluster that one task verifies; a larger cluster is verified in pairs of blocks of half as many.
CLUSTER = 512
#: Keys of candidate texts (16 bytes each) up to which they are broadcast to the scan that makes their sets.
BROADCAST_KEYS = 1_000_000

_FORM = np.zeros(256, np.uint8)
_FORM[0x30:0x3A] = np.arange(0x30, 0x3A)
_FORM[0x41:0x5B] = np.arange(0x61, 0x7B)
_FORM[0x61:0x7B] = np.arange(0x61, 0x7B)
_FORM[0x80:] = np.arange(0x80, 0x100)


def runs_for(found: float = FOUND, similar: float = SIMILAR) -> int:
    """Runs that reach the target share of pairs found."""
    return max(1, math.ceil(-math.log(max(1e-12, 1 - found)) / similar))


def sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each row's words, all n-gram hashes, and each row's range of them (rows with fewer than n
    words have one n-gram of all, rows without words none)."""
    form = _FORM[data]
    starts, ends, first = word_bounds(form != 0, offsets)
    words = word_hashes(form, starts, ends)
    one, two = row_hashes(words, first, 1), row_hashes(words, first, 2)
    size = np.diff(first)
    grams = window_hashes(words, n)
    short = np.flatnonzero((size > 0) & (size < n))
    grams = np.concatenate([grams, one[short] ^ np.uint64(0x5851F42D4C957F2D)])
    lo, hi = first[:-1].copy(), np.maximum(first[1:] - n + 1, first[:-1])
    lo[short] = len(grams) - len(short) + np.arange(len(short))
    hi[short] = lo[short] + 1
    return one, two, grams, lo, hi


def sketches(docs: DataFrame, *, text: str, keep: tuple[str, ...], n: int = WORDS) -> DataFrame:
    """``keep``, k1 and k2 (hashes of the words), n_grams (distinct) and pool (the smallest, ascending as unsigned
    numbers shifted into the signed range)."""
    names = list(keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, text):
                one, two, grams, lo, hi = sets(data, offsets, n)
                own = [np.unique(grams[a:b]) for a, b in zip(lo.tolist(), hi.tolist())]
                pools = [u[:POOL] for u in own]
                flat = np.concatenate(pools) if pools else np.zeros(0, np.uint64)
                at = np.concatenate([[0], np.cumsum([len(p) for p in pools])]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in names} | {"k1": pa.array(one.view(np.int64)), "k2": pa.array(two.view(np.int64)), "n_grams": pa.array([len(u) for u in own], pa.int64()), "pool": pa.ListArray.from_arrays(at, (flat ^ np.uint64(1 << 63)).view(np.int64))})

    schema = T.StructType([*(docs.schema[c] for c in names), *fields("k1 bigint, k2 bigint, n_grams bigint, pool array<bigint>")])
    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(scan, schema)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1 if len(keys) > 1 else np.zeros(0, int)
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(keys)])


def _whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups only, of rows that come sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in key], 1)
        changes = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in key):
            yield pa.Table.from_batches(held)
            held = []
        if len(changes):
            yield pa.Table.from_batches([*held, batch.slice(0, changes[-1])])
            held = [batch.slice(int(changes[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _overlaps(flat: np.ndarray, at: np.ndarray, left: int) -> np.ndarray:
    """Common elements of each of the first ``left`` sets with each of the others, or of all with all if
    ``left`` is 0. flat: the sets one after another, at: their borders. In blocks of columns."""
    m = len(at) - 1
    row = np.repeat(np.arange(m), np.diff(at))
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    column, count = np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(ranked)))
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    column, row = place[column], row[order]
    row, column = row[column >= 0], column[column >= 0]
    out = np.zeros((left or m, m - left), np.float32)
    wide = max(64, (8 << 20) // (4 * m))
    for lo in range(0, len(shared), wide):
        a, b = np.searchsorted(column, [lo, lo + wide])
        grid = np.zeros((m, min(wide, len(shared) - lo)), np.float32)
        grid[row[a:b], column[a:b] - lo] = 1
        out += grid[: left or m] @ grid[left:].T
    return out


def _roots(close: np.ndarray) -> np.ndarray:
    """The least index of each one's component in a symmetric boolean matrix."""
    label = np.arange(len(close))
    while True:
        new = np.minimum(label, np.where(close, label[None, :], len(label)).min(1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _ties(rows: DataFrame) -> DataFrame:
    """(u, v) ties of the rows (path, side, rep, pool) of small buckets: each text with the first of its
    component of pools that are alike."""

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["path", "side"]):
            table = table.combine_chunks()
            keys = np.stack([table.column(c).to_numpy() for c in ("path", "side")], 1)
            rep = table.column("rep").to_numpy()
            pool = table.column("pool").combine_chunks()
            flat, at = pool.values.to_numpy(), pool.offsets.to_numpy().astype(np.int64)
            us, vs = [], []
            for lo, hi in _runs(keys):
                if hi - lo < 2:
                    continue
                size = np.diff(at[lo : hi + 1])
                if hi - lo == 2:
                    common = len(np.intersect1d(flat[at[lo] : at[lo + 1]], flat[at[lo + 1] : at[hi]], True))
                    if common >= TIE * (size.sum() - common) and rep[lo] != rep[lo + 1]:
                        us.append(rep[lo])
                        vs.append(rep[lo + 1])
                    continue
                common = _overlaps(flat[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], 0)
                root = _roots(common >= TIE * (size[:, None] + size[None, :] - common))
                far = np.flatnonzero(root != np.arange(hi - lo))
                us += rep[lo + far].tolist()
                vs += rep[lo + root[far]].tolist()
            yield pa.RecordBatch.from_pydict({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    dealt = rows.select("path", "side", "rep", "pool").repartition("path", "side").sortWithinPartitions("path", "side")
    return dealt.mapInArrow(brute, "u bigint, v bigint").where("u <> v")


def _sized(paths: DataFrame) -> DataFrame:
    """(path, rep, size) of buckets of two or more."""
    size = paths.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
    return paths.join(size, "path")


def candidates(reps: DataFrame, *, found: float = FOUND, similar: float = SIMILAR) -> DataFrame:
    """(u, v) ties among the rows (rep, pool) of different texts that may be similar."""
    paths = reps.select("rep", F.explode(F.slice("pool", 1, runs_for(found, similar))).alias("path"))
    rows = cut(_sized(paths), "jaccard-buckets")
    ties, small = [], []
    before = None
    for depth in range(1, DEPTH + 2):
        small.append(rows.where(F.col("size") <= BUCKET).select("path", F.lit(0).cast("bigint").alias("side"), "rep"))
        big = rows.where(F.col("size") > BUCKET)
        now = big.count()
        if not now:
            break
        big = cut(big.join(reps.select("rep", "pool"), "rep"), "jaccard-big")
        pivot = big.groupBy("path").agg(F.min("rep").alias("pivot"))
        pivot = pivot.join(reps.select(F.col("rep").alias("pivot"), F.col("pool").alias("held")), "pivot")
        common = F.size(F.array_intersect("pool", "held"))
        near = big.join(pivot, "path").withColumn("common", common).withColumn("like", F.col("common") / (F.size("pool") + F.size("held") - F.col("common")))
        near = cut(near.select("path", "rep", "pool", "pivot", "like"), "jaccard-near")
        ties.append(near.where((F.col("like") >= TIE) & (F.col("rep") != F.col("pivot"))).select(F.col("rep").alias("u"), F.col("pivot").alias("v")))
        left = near.groupBy("path").agg(F.count_if(F.col("like") < TIE).alias("untied"), F.count_if(F.col("like") < ABSORB).alias("size")).where("untied > 0 AND size > 1")
        rest = near.where(F.col("like") < ABSORB).select("path", "rep", "pool", (F.col("like") < TIE).alias("lone")).join(left, "path")
        rest = cut(rest, "jaccard-rest")
        small.append(rest.where(F.col("size") <= BUCKET).select("path", F.lit(0).cast("bigint").alias("side"), "rep"))
        rest = rest.where(F.col("size") > BUCKET)
        last = depth > DEPTH or before is not None and now > SHRINKS * before
        before = now
        if not last:
            other = F.filter("pool", lambda x: x != F.col("path"))  # none left: all texts of this pool go on together
            other = F.when(F.size(other) > 0, other).otherwise(F.array("path"))
            chosen = F.slice(F.array_sort(F.transform(other, lambda x: F.struct(F.xxhash64("path", x).alias("h"), x.alias("x")))), 1, BRANCHES)
            rows = cut(_sized(rest.select("rep", F.explode(F.transform(chosen, lambda c: F.xxhash64(c.h, c.x, F.lit(depth)))).alias("path"))), "jaccard-buckets")
        else:  # what no split makes small: blocks of texts that aren't tied to the pivot against all blocks
            lone, tied = (F.ceil(c / BUCKET).cast("int") for c in (F.col("untied"), F.col("size") - F.col("untied")))
            place = lambda n: F.pmod(F.xxhash64("rep", F.lit(7)), F.greatest(n, F.lit(1))).cast("int")
            own = rest.select("path", "rep", "lone", lone.alias("n"), (lone + tied).alias("m"), F.when(F.col("lone"), place(lone)).otherwise(lone + place(tied)).alias("block"))
            others = F.sequence(F.lit(0), F.when(F.col("lone"), F.col("m")).otherwise(F.col("n")) - 1)
            side = F.explode(F.transform(others, lambda o: (F.least("block", o) * F.lit(1 << 31) + F.greatest("block", o)).cast("bigint")))
            small.append(own.select("path", side.alias("side"), "rep"))
            break
    rows = small[0]
    for more in small[1:]:
        rows = rows.unionByName(more)
    out = _ties(rows.join(reps.select("rep", "pool"), "rep"))
    for more in ties:
        out = out.unionByName(more)
    return out


def _sets_of(docs: DataFrame, wanted: DataFrame, text: str, n: int) -> DataFrame:
    """k1, k2 and grams (sorted distinct n-gram hashes) of the wanted keys, once for each key. The texts are
    scanned again; a bounded number of keys goes to the scan, else its rows are joined."""
    known = None
    if wanted.count() <= BROADCAST_KEYS:
        keys = np.array([tuple(r) for r in wanted.select("k1", "k2").toLocalIterator()], np.int64).reshape(-1, 2)
        known = docs.sparkSession.sparkContext.broadcast(np.sort(keys[:, 0] ^ (keys[:, 1] << 1)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        keys = known.value if known is not None else None
        for batch in batches:
            for _, data, offsets in chunks(batch, text):
                one, two, grams, lo, hi = sets(data, offsets, n)
                one, two = one.view(np.int64), two.view(np.int64)
                take = lo < hi
                if keys is not None:
                    mark = one ^ (two << 1)
                    take &= keys[np.minimum(np.searchsorted(keys, mark), len(keys) - 1)] == mark if len(keys) else False
                out = []
                for k in np.flatnonzero(take).tolist():
                    key = int(one[k]), int(two[k])
                    if key not in seen:
                        if len(seen) < BROADCAST_KEYS:
                            seen.add(key)
                        out.append((*key, np.unique(grams[lo[k] : hi[k]]).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.int64(), pa.binary()))], ["k1", "k2", "grams"])

    return docs.select(text).mapInArrow(scan, "k1 bigint, k2 bigint, grams binary").join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])


def _verify(rows: DataFrame, similar: float) -> DataFrame:
    """(rep, links, root) of rows (cluster, side, left, rep, copies, grams): documents linked to each text by
    verified pairs of its group (of the left with the others if sides differ), and the first text of its linked
    component there."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["cluster", "side"]):
            table = table.combine_chunks()
            keys = np.stack([table.column(c).to_numpy() for c in ("cluster", "side")], 1)
            rep, copies, left = table.column("rep").to_numpy(), table.column("copies").to_numpy(), table.column("left").to_numpy(zero_copy_only=False).astype(bool)
            grams = table.column("grams")
            out = [[], [], []]
            for lo, hi in _runs(keys):
                order = lo + np.argsort(~left[lo:hi], kind="stable")
                own = [np.frombuffer(grams[int(k)].as_buffer(), np.uint64) for k in order]
                at = np.concatenate([[0], np.cumsum([len(g) for g in own])])
                size, m = np.diff(at), hi - lo
                cut_at = int(left[lo:hi].sum())
                cut_at = 0 if cut_at == m else cut_at
                common = _overlaps(np.concatenate(own), at, cut_at)
                one, two = (size[:cut_at], size[cut_at:]) if cut_at else (size, size)
                linked = common >= similar * (one[:, None] + two[None, :] - common) - 1e-6
                close = np.zeros((m, m), bool)
                if cut_at:
                    close[:cut_at, cut_at:] = linked
                    close |= close.T
                else:
                    close = linked
                    np.fill_diagonal(close, False)
                some = np.flatnonzero(close.any(1))
                root = _roots(close)
                out[0] += rep[order[some]].tolist()
                out[1] += (close[some] @ copies[order]).tolist()
                out[2] += rep[order[root[some]]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["rep", "links", "root"])

    dealt = rows.select("cluster", "side", "left", "rep", "copies", "grams").repartition("cluster", "side").sortWithinPartitions("cluster", "side")
    return dealt.mapInArrow(check, "rep bigint, links bigint, root bigint")


def classes(docs: DataFrame, *, text: str = "text", row: str, doc_id: str = "doc_id", n: int = WORDS, similar: float = SIMILAR, found: float = FOUND) -> DataFrame:
    """(row, doc_id, class_id, n_links, kept) of every document; row: a column of distinct numbers.

    Words are those of lower-cased ASCII letters, digits and all characters above U+007F. A text of fewer than
    n words is one n-gram; null, empty and wordless texts have no links and are classes of their own. class_id
    is the least doc_id (nulls last) of the documents linked directly or through others, n_links the number of
    other documents at ``similar`` or above, equal texts among them. kept marks one document of each class:
    that with the least doc_id, then row."""
    own = cut(sketches(docs, text=text, keep=(row, doc_id), n=n).withColumnsRenamed({row: "no", doc_id: "id"}), "jaccard-sketches")
    with_words = own.where("n_grams > 0")
    reps = cut(with_words.groupBy("k1", "k2").agg(F.min(F.struct("no", "pool")).alias("first"), F.count("*").alias("copies"), F.min("id").alias("least")).select("k1", "k2", F.col("first.no").alias("rep"), F.col("first.pool").alias("pool"), "copies", "least"), "jaccard-texts")
    tied = connected_components(candidates(reps, found=found, similar=similar))
    tied = cut(tied.join(reps.select("k1", "k2", F.col("rep").alias("node"), "copies"), "node").select("k1", "k2", F.col("node").alias("rep"), F.col("component").alias("cluster"), "copies"), "jaccard-clusters")
    sizes = tied.groupBy("cluster").agg(F.count("*").alias("size"))
    tied = cut(_sets_of(docs, tied.join(sizes, "cluster"), text, n), "jaccard-sets")
    whole = tied.where(F.col("size") <= CLUSTER).select("cluster", F.lit(0).cast("bigint").alias("side"), F.lit(True).alias("left"), "rep", "copies", "grams")
    blocks = F.ceil(F.col("size") / (CLUSTER // 2)).cast("int")
    large = tied.where(F.col("size") > CLUSTER).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int"))
    large = large.select("cluster", "rep", "copies", "grams", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    low, high = F.least("block", "o"), F.greatest("block", "o")
    large = large.select("cluster", (low.cast("bigint") * F.lit(1 << 31) + high + 1).alias("side"), (F.col("block") == low).alias("left"), "rep", "copies", "grams")
    done = cut(_verify(whole, similar).withColumn("whole", F.lit(True)).unionByName(_verify(large, similar).withColumn("whole", F.lit(False))), "jaccard-links")
    joined = done.where("whole").select(F.col("rep").alias("node"), F.col("root").alias("component"))
    parts = done.where(~F.col("whole") & (F.col("rep") != F.col("root")))
    if not parts.isEmpty():
        joined = joined.unionByName(connected_components(parts, "rep", "root"))
    links = done.groupBy("rep").agg(F.sum("links").alias("links"))
    texts = reps.select("k1", "k2", "rep", "copies", "least").join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    texts = cut(texts.select("k1", "k2", F.coalesce("component", "rep").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least"), "jaccard-roots")
    best = texts.groupBy("root").agg(F.min("least").alias("class_id"))
    texts = texts.drop("least").join(best, "root")
    out = with_words.select("no", "id", "k1", "k2").join(texts, ["k1", "k2"])
    first = out.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "no")).alias("f")).select(F.col("f.no").alias("no"), F.lit(True).alias("kept"))
    out = out.join(first, "no", "left").select("no", "id", "class_id", "n_links", F.coalesce("kept", F.lit(False)).alias("kept"))
    alone = own.where("n_grams = 0").select("no", "id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("kept"))
    return out.unionByName(alone).select(F.col("no").alias(row), F.col("id").alias(doc_id), "class_id", "n_links", "kept")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    row = free_name(docs, "row_no")
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias(row))
    return classes(numbered, row=row, **options).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each class, byte for byte; documents without words all stay. The rows are numbered and
    cut, and those that go are joined by number: broadcast while they are few, shuffled beyond."""
    plain, names = plain_names(docs)
    place = {c.lower(): n for c, n in zip(docs.columns, names)}
    numbered = cut(plain.withColumn("row_no", F.monotonically_increasing_id()), "jaccard-documents")
    gone = cut(classes(numbered, text=place[text.lower()], row="row_no", doc_id=place[doc_id.lower()], **options).where(~F.col("kept")).select("row_no"), "jaccard-gone")
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return numbered.join(gone, "row_no", "left_anti").select(*names).toDF(*docs.columns)
