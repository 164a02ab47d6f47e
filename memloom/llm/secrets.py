"""Secret scans: patterns find candidates, then corpus-wide ownership of each candidate's hash separates
widely copied examples from credentials that belong to one owner."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.shared import cut, fields, plain_names

#: Base kinds in the order of the contract. A keyword's letters are written in both cases, so that no other
#: character folds onto them.
KINDS = ("assign", "access", "hex")
_WORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
ASSIGN = re.compile(rf"""({_WORD}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Formats that the base kinds don't name; their spans are added where ownership speaks for a live credential.
MORE = {
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
}
_SIGN = {"pem": "-----BEGIN ", "github": "gh", "slack": "xox", "google": "AIza", "jwt": "eyJ"}
ORDER = {k: n for n, k in enumerate((*KINDS, *MORE))}
#: A value that more owners than this hold is an example that people copy.
MAX_OWNERS = 3
#: Values that are broadcast to the candidates, the most frequent ones (about 100 bytes each).
HOT_VALUES = 1_000
_HEX_BYTE = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of all candidates in code points, by start, then kind as listed."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"\1" * 32 in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTE):
        out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    for kind, pattern in MORE.items():
        if _SIGN[kind] in text:
            out += [(kind, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


_SPANS = "array<struct<kind:string,lo:bigint,hi:bigint,value:string>>"


def candidates(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and found: the candidates of the whole text with their positions and the SHA-256 of their
    value (the value itself isn't carried). Null and empty texts have none."""
    names = list(keep)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("value", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "lo": a, "hi": b, "value": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()} for k, a, b, v in find(t)] if (t := x.as_py()) else [] for x in batch.column(text)]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in names} | {"found": pa.array(found, kind)})

    schema = T.StructType([*(docs.schema[c] for c in names), *fields(f"found {_SPANS}")])
    return docs.select(*dict.fromkeys([*names, text])).mapInArrow(scan, schema)


def ownership(found: DataFrame, *, repository: str, owner: str, max_owners: int = MAX_OWNERS) -> DataFrame:
    """value, n_rows, n_repositories, n_owners (distinct ones), copied (more than ``max_owners`` owners hold it).
    Null counts as no repository and no owner; a value without any owner isn't copied. Equal (value, repository,
    owner) rows meet before the shuffle that counts, so one owner with a third of all rows is one row by then."""
    held = found.select(F.explode("found.value").alias("value"), F.col(repository).cast("string").alias("r"), F.col(owner).cast("string").alias("o"))
    held = held.groupBy("value", "r", "o").agg(F.count("*").alias("n"))
    counted = held.groupBy("value").agg(F.sum("n").alias("n_rows"), F.count_distinct("r").alias("n_repositories"), F.count_distinct("o").alias("n_owners"))
    return counted.withColumn("copied", F.col("n_owners") > max_owners)


def _with_ownership(one: DataFrame, held: DataFrame) -> DataFrame:
    """``one`` (a row for each candidate) with what is known of its value. The ``HOT_VALUES`` most frequent values are
    broadcast, so that no widely copied example is a hot key; the rest, each of which has less than one in
    ``HOT_VALUES`` of the rows, is joined by value."""
    hot = F.broadcast(cut(held.orderBy(F.desc("n_rows"), "value").limit(HOT_VALUES), "secret-hot-values"))
    return one.join(hot, "value").unionByName(one.join(hot.select("value"), "value", "left_anti").join(held, "value"))


def scan(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), repository: str = "source", owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """Per document: ``keep``, base and all (arrays of kind, lo, hi), n_live and n_copied over all candidates.

    Base spans always stay; spans of the further formats are added unless their value is copied. Rows are told
    apart by a number of their own, so null and repeated ids are fine; only documents with candidates take part
    in a shuffle beside the narrow result row."""
    row = "row_"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    names = tuple(dict.fromkeys([*keep, repository, owner]))
    found = cut(candidates(docs, text=text, keep=names).withColumn(row, F.monotonically_increasing_id()), "secrets")
    some = found.where(F.size("found") > 0)
    held = cut(ownership(some, repository=repository, owner=owner, max_owners=max_owners), "secret-values")
    one = _with_ownership(some.select(row, F.explode("found").alias("x")).select(row, "x.kind", "x.lo", "x.hi", "x.value"), held)
    joined = one.groupBy(row).agg(
        F.sort_array(F.collect_list(F.when(~F.col("copied") & ~F.col("kind").isin(*KINDS), F.struct("lo", "hi", "kind")))).alias("more"),
        F.count_if(~F.col("copied")).alias("n_live"), F.count_if("copied").alias("n_copied"),
    )
    base = F.transform(F.filter("found", lambda x: x.kind.isin(*KINDS)), lambda x: F.struct(x.kind.alias("kind"), x.lo.alias("lo"), x.hi.alias("hi")))
    more = F.transform(F.coalesce("more", F.array()), lambda x: F.struct(x.kind.alias("kind"), x.lo.alias("lo"), x.hi.alias("hi")))
    place = F.create_map(*[F.lit(v) for kv in ORDER.items() for v in kv])
    whole = F.array_sort(F.concat(base, F.when(F.col("more").isNull(), F.array().cast("array<struct<kind:string,lo:bigint,hi:bigint>>")).otherwise(more)), lambda a, b: F.when(a.lo != b.lo, F.signum(a.lo - b.lo)).otherwise(place[a.kind] - place[b.kind]).cast("int"))
    rest = found.where(F.size("found") == 0).select(*keep, F.array().cast("array<struct<kind:string,lo:bigint,hi:bigint>>").alias("base"), F.array().cast("array<struct<kind:string,lo:bigint,hi:bigint>>").alias("all"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    return some.join(joined, row, "left").select(*keep, base.alias("base"), whole.alias("all"), "n_live", "n_copied").unionByName(rest)


def _line(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.lo.cast("string"), x.hi.cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """The query's digest columns over :func:`scan`."""
    got = scan(docs, **options)
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long")
    return got.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(_line("base"), 256).alias("base_sha256"), _line("all").alias("spans"), "n_live", "n_copied")


def redact(docs: DataFrame, *, text: str = "text", repository: str = "source", owner: str = "source", max_owners: int = MAX_OWNERS, mark: str = "<secret>") -> DataFrame:
    """The documents with live-looking credentials replaced by ``mark``; copied examples and all other rows stay
    byte for byte, and no row goes. n_chars, where there is such a column, follows a text that was changed."""
    plain, names = plain_names(docs)
    place = {c.lower(): n for c, n in zip(docs.columns, names)}
    own, repo, holder, sizes = place[text.lower()], place[repository.lower()], place[owner.lower()], place.get("n_chars")
    numbered = cut(candidates(plain, text=own, keep=tuple(names)).withColumn("row_no", F.monotonically_increasing_id()), "secrets")
    some = numbered.where(F.size("found") > 0)
    held = cut(ownership(some, repository=repo, owner=holder, max_owners=max_owners), "secret-values")
    live = _with_ownership(some.select("row_no", F.explode("found").alias("x")).select("row_no", "x.lo", "x.hi", F.col("x.value").alias("value")), held).where(~F.col("copied"))
    live = live.groupBy("row_no").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in names}
            texts, lengths = columns[own].to_pylist(), columns[sizes].to_pylist() if sizes else None
            for k, spans in enumerate(batch.column("spans").to_pylist()):
                if not spans:
                    continue
                out, at = [], 0
                for x in spans:
                    if x["hi"] > at:
                        out += [texts[k][at : max(at, x["lo"])], mark] if x["lo"] >= at else []
                        at = x["hi"]
                texts[k] = "".join([*out, texts[k][at:]])
                if lengths is not None:
                    lengths[k] = len(texts[k])
            columns[own] = pa.array(texts, columns[own].type)
            if lengths is not None:
                columns[sizes] = pa.array(lengths, columns[sizes].type)
            yield pa.RecordBatch.from_pydict(columns)

    changed = some.join(live, "row_no", "left").select(*names, "spans").mapInArrow(clean, plain.schema)
    return numbered.where(F.size("found") == 0).select(*names).unionByName(changed).toDF(*docs.columns)
