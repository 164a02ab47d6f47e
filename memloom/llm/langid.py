"""Language ID by multilingual mixture inference: expectation-maximisation estimates each document's language
proportions from n-gram likelihoods, and a penalised likelihood selects the set of languages."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.shared import chunks, fields

#: Hashed n-grams of three bytes, with the word borders among them.
BUCKETS = 4_096
#: Documents of one numpy step: a row of all buckets is 16 KiB.
CHUNK_ROWS = 100
SMOOTH = 0.5
STEPS = 8
#: Natural-log likelihood that one more language must gain, times the log of the n-grams; n-grams overlap, so this
#: is above the 1/2 of independent ones.
PENALTY = 4.0
#: A language below this proportion isn't tried.
LEAST = 0.02
#: A document whose n-grams are likelier under even chances of all buckets than under its languages, by this much
#: for each n-gram, is in no language that was learned.
FOREIGN = 0.35
UNKNOWN = "und"

_FORM = np.full(256, 32, np.uint8)
_FORM[0x41:0x5B] = np.arange(0x61, 0x7B)
_FORM[0x61:0x7B] = np.arange(0x61, 0x7B)
_FORM[0x80:] = np.arange(0x80, 0x100)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x buckets: how often each hashed n-gram of three bytes occurs in each row. ASCII letters are folded
    to lower case and other ASCII bytes to a space; n-grams of spaces alone don't count."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros((rows, BUCKETS), np.float32)
    form = _FORM[data].astype(np.uint32)
    code = form.copy()
    code[1:] |= form[:-1] << np.uint32(8)
    code[2:] |= form[:-2] << np.uint32(16)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    first = offsets[:-1][np.diff(offsets) > 0]
    code[first] = form[first] | np.uint32(0x202000)  # nothing of the row before
    second = offsets[:-1][np.diff(offsets) > 1] + 1
    code[second] = form[second] | (form[second - 1] << np.uint32(8)) | np.uint32(0x200000)
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    bucket += row * BUCKETS
    return np.bincount(bucket[(code != 0x202020) & (form != 32) | (code >> np.uint32(8) & np.uint32(0xFF) != 32)], minlength=rows * BUCKETS).reshape(rows, BUCKETS).astype(np.float32)


class Model:
    """Languages and their n-gram likelihoods (buckets x languages)."""

    def __init__(self, totals: dict[str, np.ndarray]) -> None:
        self.languages = sorted(totals)
        table = np.array([totals[k] for k in self.languages], np.float64).reshape(len(self.languages), BUCKETS) + SMOOTH
        self.chance = (table / table.sum(1, keepdims=True)).T.astype(np.float32)

    def mixture(self, seen: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """EM from ``share`` (rows x languages; languages at 0 stay there): proportions and log-likelihoods."""
        total = np.maximum(seen.sum(1, keepdims=True), 1)
        for _ in range(steps):
            share = share * ((seen / np.maximum(share @ self.chance.T, 1e-12)) @ self.chance) / total
            share /= np.maximum(share.sum(1, keepdims=True), 1e-12)
        return share, (seen * np.log(np.maximum(share @ self.chance.T, 1e-12))).sum(1, dtype=np.float64)

    def infer(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions over the selected languages of each row, and the log-likelihood for each n-gram.

        All languages are fitted first; then the leading 1, 2, ... of them are fitted alone, while another one
        still raises the penalised likelihood of some row."""
        rows, n = len(seen), len(self.languages)
        total = seen.sum(1)
        start, _ = self.mixture(seen, np.full((rows, n), 1 / max(1, n), np.float32), STEPS)
        order = np.argsort(-start, 1, kind="stable")
        rank = np.argsort(order, 1, kind="stable")
        penalty = PENALTY * np.log(np.maximum(total, 2))
        best, best_log, best_score = np.zeros_like(start), np.full(rows, -np.inf), np.full(rows, -np.inf)
        open_rows = np.arange(rows)
        for size in range(1, n + 1):
            if size > 1:
                open_rows = open_rows[start[open_rows, order[open_rows, size - 1]] >= LEAST]
            if not len(open_rows):
                break
            share = np.where(rank[open_rows] < size, start[open_rows], 0).astype(np.float32)
            share /= np.maximum(share.sum(1, keepdims=True), 1e-12)
            share, log = self.mixture(seen[open_rows], share, STEPS if size > 1 else 0)
            score = log - penalty[open_rows] * (size - 1)
            better = score > best_score[open_rows]
            took = open_rows[better]
            best[took], best_log[took], best_score[took] = share[better], log[better], score[better]
        return best, best_log / np.maximum(total, 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents that nothing is learned from: crc32 of the id as text, modulo 4, is 2. A null id
    counts as the empty text, which is not held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Likelihoods from text and non-null lang of all documents that aren't held out; each language's are shares of its
    own counts, so a rare one is learned as well. Counts of n-grams are summed up by language and bucket in each task
    and then in the cluster; only the sums, at most ``BUCKETS`` for each language, reach the driver."""
    rows = docs.where(F.col(lang).isNotNull() & ~held_out(doc_id)).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, data, offsets in chunks(batch, "text", rows=CHUNK_ROWS):
                seen, langs = counts(data, offsets), np.array(part.column("lang").to_pylist(), object)
                for k in set(langs):
                    totals[k] = totals.get(k, 0) + seen[langs == k].sum(0, dtype=np.float64)
        for k, v in totals.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(v[at].astype(np.int64))})

    totals: dict[str, np.ndarray] = {}
    for row in rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        totals.setdefault(row.lang, np.zeros(BUCKETS))[row.bucket] = row.n
    return Model(totals)


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score (its proportion of the document), languages (map of the selected set's
    proportions) and foreign (no learned language explains the text).

    Whole texts count. Null text, text without any letter, and every text where nothing could be learned are
    ``und`` with score 0. Ties go to the language first by name. Documents are never shuffled."""
    names = list(keep)
    schema = T.StructType([*(docs.schema[c] for c in names), *fields("lang_pred string, score double, languages map<string,double>, foreign boolean")])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters = np.zeros(256, bool)
    letters[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part, data, offsets in chunks(batch, text, rows=CHUNK_ROWS):
                n = len(part)
                seen = counts(data, offsets)
                pred, score, sets, foreign = [UNKNOWN] * n, [0.0] * n, [{}] * n, [False] * n
                plain = np.concatenate([[0], np.cumsum(letters[data])])[offsets]
                if own.languages:
                    share, each = own.infer(seen)
                    limit = math.log(1 / BUCKETS) - FOREIGN
                    for k in range(n):
                        if plain[k + 1] == plain[k] and not any(map(str.isalpha, part.column(text)[k].as_py() or "")):
                            continue
                        top = int(share[k].argmax())
                        pred[k], score[k] = own.languages[top], min(1.0, max(0.0, float(share[k, top])))
                        sets[k] = {own.languages[j]: float(share[k, j]) for j in np.flatnonzero(share[k] >= LEAST)}
                        foreign[k] = bool(each[k] < limit)
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in names} | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "languages": pa.array([list(s.items()) for s in sets], pa.map_(pa.string(), pa.float64())), "foreign": pa.array(foreign, pa.bool_())})

    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(scan, schema)


def report(docs: DataFrame, *, text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The query's digest columns: learned without the held-out documents, predicted for all."""
    model = learn(docs, text=text, lang=lang, **options)
    return identify(docs, model, text=text).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages", "foreign")


def keep_known(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents whose text is in a learned language, byte for byte; those that are ``und`` or foreign go."""
    model = learn(docs, text=text, lang=lang)
    names = [f"column{k}_" for k in range(len(docs.columns))]  # so that no result column clashes with one of docs
    own = names[[c.lower() for c in docs.columns].index(text.lower())]
    known = identify(docs.toDF(*names), model, text=own, keep=tuple(names)).where((F.col("lang_pred") != UNKNOWN) & ~F.col("foreign"))
    return known.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
