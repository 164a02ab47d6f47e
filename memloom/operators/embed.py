"""Vectors of texts without a neural model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.functions import text as text_functions
from memloom.functions import vec
from memloom.sources.scratch import cut


def hash_vectors(rows: DataFrame, text: str = "text", dim: int = 256, *, forward: str = vec.FORWARD_PROMPT, backward: str = vec.BACKWARD_PROMPT) -> DataFrame:
    """``rows`` with unit vectors f, b and s (forward, backward, symmetric) of ``text``: eight numbers of its hashes
    repeated up to ``dim``, a multiple of 8. Null texts have null vectors.

    Each step has its own projection, so that no hash and no norm is computed again for each element."""
    own, other = vec.HASH_SHARES
    body = F.col(text)
    mixed = lambda v: F.zip_with("_t", v, lambda x, y: own * x + other * y)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x) * (dim // 8))
    unit = lambda v, n: F.when(F.col(n) > 1e-12, F.transform(v, lambda x: x / F.col(n))).otherwise(F.col(v))
    wide = lambda v: F.when(body.isNotNull(), F.flatten(F.array_repeat(v, dim // 8)))
    out = rows.withColumns({"_t": vec.hash_period("text", body, 0), "_f": vec.hash_period(forward, body, 1), "_b": vec.hash_period(backward, body, 2)})
    out = out.withColumns({"_f": mixed("_f"), "_b": mixed("_b")})
    out = out.withColumns({"_nf": size("_f"), "_nb": size("_b")})
    out = out.withColumns({"_f": unit("_f", "_nf"), "_b": unit("_b", "_nb")})
    out = out.withColumn("_s", F.zip_with("_f", "_b", lambda x, y: (x + y) / 2))
    out = out.withColumn("_ns", size("_s"))
    out = out.withColumns({"f": wide("_f"), "b": wide("_b"), "s": wide(unit("_s", "_ns"))})
    return out.drop("_t", "_f", "_b", "_s", "_nf", "_nb", "_ns")


# The ways to ask for what follows and what came before.
FORWARD_PROMPTS = (vec.FORWARD_PROMPT, "What follows after: ", "Predict the consequence of: ", "What is caused by: ", "Subsequent to this, what happens: ")
BACKWARD_PROMPTS = (vec.BACKWARD_PROMPT, "What precedes: ", "What is the cause of: ", "What led to: ", "Prior to this, what was the case: ")


def paraphrased(rows: DataFrame, text: str = "text", *, prompts: int = 3, dim: int = 256, embed=hash_vectors) -> DataFrame:
    """``rows`` with f, b and s: the mean of the unit vectors that the first ``prompts`` ways of asking give, unit
    again. One way after another, so that no more than one set of vectors is added."""
    count = max(1, min(prompts, len(FORWARD_PROMPTS)))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    out = rows
    for k in range(count):
        out = embed(out, text, dim, forward=FORWARD_PROMPTS[k], backward=BACKWARD_PROMPTS[k]).drop("s")
        out = out.withColumns({c: vec.l2_normalize(F.col(c)) for c in ("f", "b")})
        out = out.withColumns({f"sum_{c}": add(f"sum_{c}", c) if k else F.col(c) for c in ("f", "b")}).drop("f", "b")
    out = out.withColumns({c: vec.l2_normalize(F.col(f"sum_{c}")) for c in ("f", "b")}).drop("sum_f", "sum_b")
    return out.withColumn("s", vec.l2_normalize(vec.semantic(F.col("f"), F.col("b"))))


def expanded(rows: DataFrame, text: str = "text", *, forward, backward, dim: int = 256, embed=hash_vectors) -> DataFrame:
    """``rows`` with f, b and s: the forward vector of what ``forward`` makes of the text and the backward vector of
    what ``backward`` does (column functions, of a language model for instance). Each distinct text is asked once."""
    asked = cut(rows.select(F.col(text).alias("asked_")).where("asked_ IS NOT NULL").distinct().select("asked_", forward(F.col("asked_")).alias("then_"), backward(F.col("asked_")).alias("before_")), "expansions")
    there = embed(asked.select("asked_", "then_"), "then_", dim).select("asked_", "f")
    back = embed(asked.select("asked_", "before_"), "before_", dim).select("asked_", "b")
    both = there.join(back, "asked_").withColumn("s", vec.l2_normalize(vec.semantic(F.col("f"), F.col("b"))))
    return rows.join(both, F.col(text) == F.col("asked_"), "left").drop("asked_")


class GramVectors:
    """Vectors of the character n-grams of texts: logarithm of the count times the rarity, turned to ``dim`` numbers
    by a fixed random matrix. The ``features`` most frequent n-grams are learned from all texts."""

    def __init__(self, names: list[str], rarity: np.ndarray, dim: int, seed: int = 2026) -> None:
        self.dim, self.rarity = dim, rarity
        self.at = {g: k for k, g in enumerate(names)}
        self.turn = (np.random.default_rng(seed).standard_normal((len(names), dim)) / np.sqrt(dim)).astype(np.float32)

    @classmethod
    def fit(cls, rows: DataFrame, text: str = "text", *, features: int = 8_192, dim: int = 256, seed: int = 2026) -> GramVectors:
        """Counts are combined in each task before the shuffle; ``features`` rows reach the driver."""
        texts = rows.where(F.col(text).isNotNull())
        grams = texts.select(F.monotonically_increasing_id().alias("row"), F.explode(text_functions.char_grams(F.col(text))).alias("g")).groupBy("row", "g").agg(F.count("*").alias("n"))
        best = grams.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("df")).orderBy(F.desc("n"), "g").limit(features)
        total, known = texts.count(), sorted((r.g, r.df) for r in best.collect())
        return cls([g for g, _ in known], np.log((1 + total) / (1 + np.array([n for _, n in known], float))) + 1, dim, seed)

    def _rows(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for k, value in enumerate(texts):
            seen: dict[int, int] = {}
            for g in _grams(value or ""):
                if g in self.at:
                    seen[self.at[g]] = seen.get(self.at[g], 0) + 1
            if seen:
                own = np.fromiter(seen, int)
                weight = (1 + np.log(np.fromiter(seen.values(), float))) * self.rarity[own]
                out[k] = (weight / np.linalg.norm(weight)) @ self.turn[own]
        return out

    def embed(self, rows: DataFrame, text: str = "text", dim: int | None = None, *, forward: str = vec.FORWARD_PROMPT, backward: str = vec.BACKWARD_PROMPT) -> DataFrame:
        """``rows`` with unit vectors f, b and s."""
        held, names = rows.sparkSession.sparkContext.broadcast(self), [c for c in rows.columns if c not in ("f", "b", "s")]
        schema = T.StructType([*(rows.schema[c] for c in names), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("f", "b", "s"))])

        def unit(v: np.ndarray) -> np.ndarray:
            size = np.linalg.norm(v, axis=1, keepdims=True)
            return np.where(size > 1e-12, v / np.maximum(size, 1e-12), v)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = held.value
            for batch in (b.slice(k, 1_000) for b in batches for k in range(0, len(b), 1_000)):
                texts = batch.column(text).to_pylist()
                f, b = (unit(own._rows([p + (t or "") for t in texts])) for p in (forward, backward))
                at = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * own.dim)
                lists = [pa.ListArray.from_arrays(at, pa.array(v.ravel())) for v in (f, b, unit((f + b) / 2))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *lists], [*names, "f", "b", "s"])

        return rows.select(*names).mapInArrow(scan, schema)


def _grams(text: str) -> Iterator[str]:
    for word in text.lower().split():
        padded = f" {word} "
        for n in (3, 4, 5):
            if n > 3 and n > len(padded):
                break
            yield from (padded[k : k + n] for k in range(max(1, len(padded) - n + 1)))


def embedder(rows: DataFrame | None = None, *, prefer: str = "grams", model=None, dim: int = 256):
    """A function (rows, text, dim) that adds f, b and s: ``model`` if one is given, n-gram vectors fitted to ``rows``,
    else hash vectors."""
    if model is not None:
        return model
    if prefer == "grams" and rows is not None and not rows.isEmpty():
        return GramVectors.fit(rows, dim=dim).embed
    return hash_vectors
