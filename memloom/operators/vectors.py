"""Vector search: a stated query set against all rows. Few queries are broadcast in blocks, many are dealt to tasks that
the rows pass by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from memloom.sources.scratch import cut

#: Queries of one block at most, and rows of one step of a task: with TILE queries at once 2 MiB of scores. More queries
#: take more blocks, not more memory.
BLOCK, STEP, TILE = 65_536, 1_024, 512
#: Bytes of a block's vectors at most.
BLOCK_BYTES = 32 << 20
#: Queries that are broadcast however few the rows are; beyond it, where there are this many rows to a query.
FEW, ROWS_EACH = 2_048, 8
#: Pairs that a task is worth.
PAIRS = 500_000_000


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else np.array(column.to_pylist(), object if pa.types.is_string(column.type) else None)


class _Held:
    """A block of queries and the best rows for each so far. Scores of all pairs are single-precision products (double
    for l2), which leave out the pairs below a query's worst kept row by more than their error; the others are scored
    exactly, alike for equal vectors, so that ties are ties."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, labels: np.ndarray | None, k: int, metric: str, *, other_than_self: bool, earlier: bool) -> None:
        self.k, self.cosine, self.not_self, self.earlier = k, metric == "cosine", other_than_self, earlier
        at, v = self._usable(v)
        self.ids, self.v, self.labels = ids[at], v, None if labels is None else labels[at]
        self.quick = v.astype(np.float32) if self.cosine else v
        self.square = None if self.cosine else (v * v).sum(1)
        self.score = np.full((len(v), k), -np.inf)
        self.found: np.ndarray | None = None

    def _usable(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vectors that can be scored, and these, as unit vectors for the cosine."""
        with np.errstate(all="ignore"):
            if self.cosine:
                size = np.linalg.norm(v, axis=1)
                at = np.flatnonzero(np.isfinite(size) & (size >= 1e-12))
                return at, v[at] / size[at, None]
            at = np.flatnonzero(np.isfinite((v * v).sum(1)))
            return at, v[at]

    def _first_of_equal(self, ids: np.ndarray, v: np.ndarray, labels: np.ndarray | None) -> np.ndarray:
        """Places of the rows without those that k + 1 rows of equal vectors (and labels) and lesser ids precede."""
        raw = np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * 8))).ravel()
        _, kind, count = np.unique(raw, return_inverse=True, return_counts=True)
        if count.max() <= self.k + 1:
            return np.arange(len(ids))
        keys = [np.unique(ids.astype(str) if ids.dtype == object else ids, return_inverse=True)[1], kind]
        if labels is not None:
            keys.insert(1, np.unique(labels.astype(str), return_inverse=True)[1])
        order = np.lexsort(keys)
        group = np.stack([x[order] for x in keys[1:]])
        begins = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(0)]))
        place = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
        return np.sort(order[place <= self.k])

    def _allowed(self, qi: np.ndarray, ids: np.ndarray, labels: np.ndarray | None) -> np.ndarray:
        """Of pairs of a query's place and a row, which may count."""
        ok = np.ones(np.broadcast_shapes(qi.shape, ids.shape), bool)
        if labels is not None:
            ok &= self.labels[qi] != labels
        if self.earlier:
            ok &= ids < self.ids[qi]
        if self.not_self:
            ok &= ids != self.ids[qi]
        return ok

    def add(self, ids: np.ndarray, v: np.ndarray, labels: np.ndarray | None = None) -> None:
        at, v = self._usable(v)
        ids, labels = ids[at], None if labels is None else labels[at]
        if not len(at) or not len(self.ids):
            return
        if len(at) > 64:
            few = self._first_of_equal(ids, v, labels)
            ids, v, labels = ids[few], v[few], None if labels is None else labels[few]
        one = labels[0] if labels is not None and (labels == labels[0]).all() else None
        quick, square = (v.astype(np.float32), None) if self.cosine else (v, (v * v).sum(1))
        d = v.shape[1]
        if self.found is None:
            self.found = np.zeros(self.score.shape, ids.dtype)
        for begin in range(0, len(self.ids), TILE):
            own = np.arange(begin, min(begin + TILE, len(self.ids)))
            if one is not None:  # rows of one label: the queries that have it are left out before they are multiplied
                own = own[self.labels[own] != one]
            if not len(own):
                continue
            score = self.quick[own] @ quick.T
            if self.cosine:
                off = np.full(len(own), (d + 8) * 1.2e-7)
            else:
                score = 2 * score - self.square[own, None] - square[None, :]
                off = (d + 8) * 4e-16 * (np.sqrt(self.square[own]) + np.sqrt(square.max())) ** 2
            least = self.score[own, -1] - off
            fresh = np.flatnonzero(np.isneginf(least))
            if len(fresh) and score.shape[1] > self.k:  # queries without k rows so far: the k-th of these rows bounds them
                part = np.where(self._allowed(own[fresh][:, None], ids[None, :], None if labels is None else labels[None, :]), score[fresh], -np.inf)
                least[fresh] = np.partition(part, part.shape[1] - self.k, axis=1)[:, part.shape[1] - self.k] - 2 * off[fresh]
            hit = np.flatnonzero(score >= np.nextafter(least.astype(score.dtype), -np.inf, dtype=score.dtype)[:, None])
            for k in range(0, len(hit), 1 << 16):
                qi, ri = np.divmod(hit[k : k + (1 << 16)], score.shape[1])
                qi = own[qi]
                ok = self._allowed(qi, ids[ri], None if labels is None else labels[ri])
                self._keep(qi[ok], ri[ok], ids, v)

    def _keep(self, qi: np.ndarray, ri: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        if self.cosine:
            exact = np.einsum("ij,ij->i", self.v[qi], v[ri])
        else:
            gap = self.v[qi] - v[ri]
            exact = -np.einsum("ij,ij->i", gap, gap)
        better = exact >= self.score[qi, -1]
        qi, ri, exact = qi[better], ri[better], exact[better]
        if not len(qi):
            return
        touched = np.unique(qi)
        who = np.concatenate([np.repeat(touched, self.k), qi])
        score = np.concatenate([self.score[touched].ravel(), exact])
        names = np.concatenate([self.found[touched].ravel(), ids[ri]])
        order = np.lexsort((names.astype(str) if names.dtype == object else names, -score, who))
        begins = np.searchsorted(who[order], touched)
        kept = order[begins[:, None] + np.arange(self.k)[None, :]]
        self.score[touched], self.found[touched] = score[kept], names[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The queries' ids, the found rows' ids, scores and ranks."""
        at, place = np.nonzero(self.score > -np.inf)
        return self.ids[at], np.zeros(0, np.int64) if self.found is None else self.found[at, place], self.score[at, place], place + 1


def top_k(queries: DataFrame, rows: DataFrame, k: int, *, other_than_self: bool = False, earlier: bool = False, scope: str | None = None, apart: str | None = None, metric: str = "cosine") -> DataFrame:
    """(qid, id, score, rank) of the ``k`` rows nearest to each query: by cosine, or by squared distance (``l2``; the
    score is its negative). queries: (qid, v), rows: (id, v), ids of any number type or strings. Both have a column
    ``scope`` to match, or ``apart`` to differ in, if one is named; ``earlier`` keeps only rows of lesser id than the
    query's. Null vectors, and for the cosine those without a direction, are left out; ties go to the lesser id.

    A few queries are broadcast, and every task keeps k of its rows for each. Otherwise the queries are dealt to groups
    within their scope, and the rows of the scope pass by each group, which holds its queries and k rows for each: no
    row meets a query of another scope, and nothing but counts goes through the driver."""
    label = scope or apart
    more = [F.col(label).cast("string").alias("label")] if label else []
    asked = cut(queries.where("v IS NOT NULL AND qid IS NOT NULL").select("qid", "v", *more), "queries")
    held = rows.where("v IS NOT NULL AND id IS NOT NULL").select("id", "v", *more)
    if label:
        asked, held = asked.fillna("None", ["label"]), held.fillna("None", ["label"])
    options = {"k": k, "metric": metric, "other_than_self": other_than_self, "earlier": earlier}
    n = asked.count()
    size = asked.select(F.size("v").alias("d")).first()
    block = max(1, min(BLOCK, BLOCK_BYTES // max(8, 8 * size.d))) if size else BLOCK
    total = None if scope else held.count()
    if not scope and (n <= FEW or n * ROWS_EACH <= total):
        return _broadcast(asked, held, n, total, block, bool(apart), options)
    return _dealt(asked, held, n, total, block, scope, bool(apart), options)


def _schema(asked: DataFrame, held: DataFrame) -> tuple[T.StructType, list[pa.DataType]]:
    kinds = asked.schema["qid"].dataType, held.schema["id"].dataType
    return T.StructType([T.StructField("qid", kinds[0]), T.StructField("id", kinds[1]), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]), [to_arrow_type(t) for t in kinds]


def _batch(parts: list[tuple[np.ndarray, ...]], arrow: list[pa.DataType]) -> pa.RecordBatch:
    qid, found, score, rank = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(qid.tolist(), arrow[0]), pa.array(found.tolist(), arrow[1]), pa.array(score), pa.array(rank.astype(np.int32))], ["qid", "id", "score", "rank"])


def _broadcast(asked: DataFrame, held: DataFrame, n: int, total: int, block: int, apart: bool, options: dict) -> DataFrame:
    sc = held.sparkSession.sparkContext
    schema, arrow = _schema(asked, held)
    count = max(1, -(-n // block))
    if n * total > PAIRS:  # a table of a few files would be a few tasks
        held = held.repartition(4 * sc.defaultParallelism)
    out = None
    for part in range(count):
        own = (asked if count == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(count)) == part)).toArrow().combine_chunks()
        get = lambda name: own.column(name).combine_chunks()
        shared = sc.broadcast((_ids(get("qid")), _matrix(get("v")) if len(own) else np.zeros((0, 1)), np.array(get("label").to_pylist(), object) if apart else None))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = _Held(*shared.value, **options)
            for batch in (b.slice(at, STEP) for b in batches for at in range(0, len(b), STEP)):
                best.add(_ids(batch.column("id")), _matrix(batch.column("v")), np.array(batch.column("label").to_pylist(), object) if apart else None)
            if len((got := best.rows())[0]):
                yield _batch([got], arrow)

        one = held.mapInArrow(scan, schema)
        if count > 1:
            one = cut(one, "nearest")
            shared.destroy()
        out = one if out is None else out.unionByName(one)
    place = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= options["k"])


def _dealt(asked: DataFrame, held: DataFrame, n: int, total: int | None, block: int, scope: str | None, apart: bool, options: dict) -> DataFrame:
    spark = held.sparkSession
    schema, arrow = _schema(asked, held)
    own = F.col("label") if scope else F.lit("")
    a, b = asked.withColumn("s", own), held.withColumn("s", own)
    wide = 2 * spark.sparkContext.defaultParallelism
    # into how many groups a scope's queries are dealt: as many as fit, and in a large one as many as there is work for
    if scope:
        sizes = a.groupBy("s").agg(F.count("*").alias("q")).join(b.groupBy("s").agg(F.count("*").alias("r")), "s").withColumn("w", F.col("q").cast("double") * F.col("r"))
        sizes = cut(sizes, "scopes")
        work = sizes.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
        groups = F.greatest(F.ceil(F.col("q") / block), F.least(F.ceil(wide * F.col("w") / max(work, 1.0)), F.ceil(F.col("w") / PAIRS)))
        large = F.broadcast(sizes.withColumn("c", groups.cast("int")).where("c > 1").select("s", "c"))  # those beyond a block or a task
        a, b = (x.join(large, "s", "left").fillna(1, ["c"]) for x in (a, b))
        partitions = None
    else:
        c = max(1, -(-n // block), min(wide, -(-n * total // PAIRS)))
        a, b = (x.withColumn("c", F.lit(c)) for x in (a, b))
        partitions = min(4 * c, max(c, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kinds = schema["qid"].dataType, schema["id"].dataType
    names = F.col("label") if apart else F.lit(None).cast("string")
    a = a.select("s", F.pmod(F.xxhash64("qid"), F.col("c")).cast("int").alias("g"), F.lit(0).alias("side"), "qid", F.lit(None).cast(kinds[1]).alias("id"), "v", names.alias("label"))
    b = b.select("s", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("g"), F.lit(1).alias("side"), F.lit(None).cast(kinds[0]).alias("qid"), "id", "v", names.alias("label"))
    both = a.unionByName(b)
    both = both.repartition(partitions, "s", "g") if partitions else both.repartition("s", "g")
    order = ["s", "g", "side", *(["label"] if apart else [])]  # rows of one label come together

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asks, best, out, size = None, [], None, [], 0

        def done() -> int:
            if best is not None and len((got := best.rows())[0]):
                out.append(got)
                return len(got[0])
            return 0

        for batch in batches:
            n = len(batch)
            if not n:
                continue
            s, g, side = (batch.column(c) for c in ("s", "g", "side"))
            changes = np.zeros(n - 1, bool)
            for c in (s, g, side):
                changes |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(changes) + 1, [n]])
            v, labels = _matrix(batch.column("v")), np.array(batch.column("label").to_pylist(), object) if apart else None
            side = side.to_numpy()
            for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
                at = s[begin].as_py(), g[begin].as_py()
                if at != key:
                    size += done()
                    key, asks, best = at, [], None
                    if size >= 10_000:
                        yield _batch(out, arrow)
                        out, size = [], 0
                if side[begin] == 0:
                    asks.append((_ids(batch.column("qid").slice(begin, end - begin)), v[begin:end], labels[begin:end] if apart else None))
                    continue
                if best is None:
                    if not asks:
                        continue  # no query in this scope
                    best = _Held(*(np.concatenate(x) if x[0] is not None else None for x in zip(*asks)), **options)
                    asks = []
                for k in range(begin, end, STEP):
                    stop = min(k + STEP, end)
                    best.add(_ids(batch.column("id").slice(k, stop - k)), v[k:stop], labels[k:stop] if apart else None)
        done()
        if out:
            yield _batch(out, arrow)

    return cut(both.sortWithinPartitions(*order).mapInArrow(scan, schema), "nearest")
