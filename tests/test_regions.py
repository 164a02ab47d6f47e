"""Regions, hash vectors, packing and streams against plain Python."""

import hashlib
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import text, vec
from memloom.operators import embed, graph, regions
from memloom.streaming import dedup

SCHEMA = "region string, id long, s array<double>, role string, quality double, text string"


def region_rows(spark):
    rows = [("a", 0, [1.0, 0.0], "fact", 0.1, "x"), ("a", 1, [0.0, 1.0], "outcome", 0.2, None), ("a", 2, [0.0, 2.0], None, 0.9, "z"), ("b", 7, [1.0, 1.0], "fact", 0.5, "w")]
    return spark.createDataFrame(rows, SCHEMA)


def links(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, edge_type string, weight double")


def test_parts_of_the_priority(spark):
    e = links(spark, [(1, 2, "agrees", 0.9), (2, 1, "agrees", 0.9), (0, 1, "pivots", 0.2), (0, 7, "agrees", 0.5)])
    got = {r.region: r for r in regions.priority(region_rows(spark), e).collect()}
    a = got["a"]
    assert a.divergence == pytest.approx(0.5) and a.collapse == pytest.approx(2 / 3)
    assert a.sycophancy == pytest.approx(0.5)  # one of two: a missing role counts as a plain fact
    assert a.correction == pytest.approx(1.5 * 1.0 * (0.5 + 0.8))
    assert a.uplift == pytest.approx(1 - 0.05 * math.log(4)) and a.rarity == pytest.approx(1 / (1 + 3 / 2))
    assert a.priority == pytest.approx(0.5 - 2 / 3 - 0.5 + 1.95 + 0.5 * a.uplift + 0.5 * a.rarity)
    assert got["b"].divergence == got["b"].collapse == got["b"].correction == got["b"].sycophancy == 0
    gaps = {r.region: r.gap for r in regions.density_gaps(region_rows(spark), e).collect()}
    assert gaps == {"a": 0.0, "b": 1.0}


def test_empty_graph_has_no_rows(spark):
    assert regions.priority(region_rows(spark).limit(0), links(spark, [])).count() == 0


def test_linearize(spark):
    e = links(spark, [(0, 2, "supports", 0.5), (0, 7, "supports", 0.5)])
    got = {r.region: r.text for r in regions.linearize(region_rows(spark), e).collect()}
    assert got["a"] == "[N1] (fact) x\n    --(supports, w=+0.500)--> [N3]\n[N2] (outcome) \n[N3] (fact) z"


def test_hash_vectors_equal_numpy(spark):
    texts = ["", "a cat", "zwölf Äpfel"]
    got = embed.hash_vectors(spark.createDataFrame([(t,) for t in [*texts, None]], "text string"), dim=64).collect()

    def period(prompt, t, seed):
        digest = hashlib.sha256(f"{prompt}::{t}::{seed}".encode()).digest()
        return np.array(struct.unpack("<8I", digest)) / (2**32 - 1) * 2 - 1

    unit = lambda v: v / np.linalg.norm(v)
    by = {r.text: r for r in got}
    for t in texts:
        f = unit(np.tile(0.7 * period("text", t, 0) + 0.3 * period(vec.FORWARD_PROMPT, t, 1), 8))
        b = unit(np.tile(0.7 * period("text", t, 0) + 0.3 * period(vec.BACKWARD_PROMPT, t, 2), 8))
        assert np.allclose(by[t].f, f) and np.allclose(by[t].b, b) and np.allclose(by[t].s, unit((f + b) / 2))
    assert by[None].f is None


def test_pack(spark):
    spans = ["a b c", "d e f", "g h i j k l m n o", "p q r"]
    row = spark.createDataFrame([(spans,), ([],), (None,)], "x array<string>").select(text.pack(F.col("x"), 5, 10).alias("c")).collect()
    assert row[0].c == ["a b c d e f", "g h i j k l m n o", "p q r"] and row[1].c == [] and row[2].c is None


def test_support_tag(spark):
    answers = ["[Supported]", "[supported] or [NOT SUPPORTED]", "x [Irrelevant] y", "none", None]
    got = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, a string").orderBy("k").select(text.support_tag(F.col("a")).alias("s"))
    assert [r.s for r in got.collect()] == [0.85, 0.10, 0.05, None, None]


def test_harmonic_components(spark):
    # 0-1-2: signs round the cycle multiply to one; 3-4-5: to minus one; 6 alone; 7-8: two edges that disagree.
    e = links(spark, [(0, 1, "agrees", 1.0), (1, 2, "contradicts", 1.0), (0, 2, "contradicts", 1.0), (3, 4, "agrees", 1.0), (4, 5, "agrees", 1.0), (3, 5, "contradicts", 1.0), (7, 8, "pending", 1.0), (8, 7, "pending", 1.0)])
    got = {r.component: r.harmonic for r in graph.harmonic_dimension(spark.range(9), e).collect()}
    assert got == {0: True, 3: False, 6: True, 7: False}
    lap = np.zeros((9, 9))
    for r in graph.sheaf_laplacian(e).collect():
        lap[r.u, r.v] = r.value
    assert sum(got.values()) == int((np.abs(np.linalg.eigvalsh(lap)) < 1e-9).sum())


def test_stream_keeps_each_text_once(spark, tmp_path):
    rows = [("A b",), ("a B ",), ("c",), (None,), ("c",)]
    spark.createDataFrame(rows, "text string").repartition(3).write.parquet(str(tmp_path / "in"))
    got = dedup.drain(dedup.distinct_texts(spark.readStream.schema("text string").parquet(str(tmp_path / "in"))), "t")
    assert sorted(r.h for r in got.collect()) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in ("a b", "c"))
