"""Statistical bounds and edge evidence as columns; null stands for a vacuous bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators import ranks

NOISE = 0.0016


def crc_hoeffding(risk: Column, n: Column, delta: float = 0.05) -> Column:
    return F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), risk + F.sqrt(F.log(F.lit(1 / delta)) / (2 * n))))


def crc_wilson(risk: Column, n: Column, delta: float = 0.05) -> Column:
    """The upper end of the Wilson interval at z = sqrt(2 ln(e / delta))."""
    z2 = 2 * F.log(F.exp(F.lit(1.0)) / delta)
    centre, spread = risk + z2 / (2 * n), F.sqrt(z2) * F.sqrt(risk * (1 - risk) / n + z2 / (4 * n * n))
    return F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), (centre + spread) / (1 + z2 / n)))


def chebyshev_cantelli(loss: Column, tandem: Column, kl: Column, n: Column, delta: float = 0.05) -> Column:
    margin = 2 * (loss - tandem)
    rest = F.sqrt(2 * (kl + F.log(2 * F.sqrt(n) / delta)) / n)
    ok = (n > 0) & (margin > 0) & (margin - rest > 0) & (1 - margin + rest > 0)
    return F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.pow((margin + rest) / (1 - margin + rest), F.lit(2.0)))))


def pac_bayes(tandem: Column, kl: Column, n: Column, delta: float = 0.05) -> Column:
    return F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), 4 * (tandem + (kl + F.log(2 * F.sqrt(n) / delta)) / n)))


def rag_bound(loss: Column, n: Column, distortion: Column, delta: float = 0.05) -> Column:
    """Bias, variance 1 - exp(-1/n), retrieval noise and a confidence term; the embedding's size cancels out."""
    raw = loss + (1 - F.exp(-1 / n)) + F.greatest(F.lit(0.0), distortion) + F.sqrt(F.log(F.lit(2 / delta)) / (2 * n))
    return F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def estimate_cheeger(edges: Column, nodes: Column) -> Column:
    return F.when(nodes <= 1, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(2.0 / F.greatest(F.lit(1), nodes - 1), edges / F.greatest(F.lit(1), nodes) / 2)))


def spectral_bound(edges: Column, cheeger: Column, base: float = 0.1) -> Column:
    return F.when((edges > 0) & (cheeger > 0), F.least(F.lit(1.0), base + (1 / cheeger) / F.sqrt(edges)))


def composite_bound(rag: Column, spectral: Column) -> Column:
    return F.when(rag.isNotNull() & spectral.isNotNull(), F.least(F.lit(1.0), rag + 0.5 * spectral)).otherwise(F.coalesce(rag, spectral))


def bmrs_log_ratio(w: Column, s2: Column, prior: float = 1.0) -> Column:
    """Log evidence that the weight is zero against a normal prior of that variance; above 0: prune."""
    s, p = F.greatest(s2, F.lit(1e-6)), max(prior, 1e-6)
    return 0.5 * F.log(p / s) - 0.5 * w * w * (p - s) / (s * p)


def cosine_edge_variance(w: Column, anti: Column, noise: float = NOISE) -> Column:
    ratio = F.least(F.lit(1.0), F.abs(anti) / (F.abs(w) + 1e-6))
    return F.when(anti.isNull() | (F.abs(w) <= 1e-6), F.lit(noise)).otherwise(F.greatest(F.lit(1e-6), noise / F.greatest(F.lit(0.1), 0.5 + 0.5 * ratio)))


def should_prune(w: Column, s2: Column, prior: float = 1.0) -> Column:
    return bmrs_log_ratio(w, s2, prior) > 0


def gamma_edge_variance(score: Column, anti: Column) -> Column:
    """The older estimate from the two parts' ratio, between 0.05 and 2; the plain noise without the second part."""
    ratio = (F.abs(anti) + 1e-6) / (F.abs(score) + 1e-6)
    return F.when(anti.isNull(), F.lit(NOISE)).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(2.0), 1 / (ratio + 0.1))))


def bound_estimate(paths: Column, loss: Column, tandem: Column, n: Column, delta: float = 0.05) -> Column:
    """The bound for so many walks, whose number's logarithm stands for the divergence; null without any."""
    kl = F.log(F.greatest(F.lit(1), paths).cast("double"))
    return F.when(paths > 0, chebyshev_cantelli(loss, tandem, kl, n, delta))


def is_vacuous(bound: Column) -> Column:
    return bound.isNull() | (bound >= 1)


def risk_bounds(rows: DataFrame, risk: str, group: list[str], delta: float = 0.05) -> DataFrame:
    """The group columns, n (risks that aren't null), risk (their mean), hoeffding, wilson and best, the lesser of the
    two; all 1 where n is 0."""
    own = rows.groupBy(*group).agg(F.count(risk).alias("n"), F.avg(F.col(risk).cast("double")).alias("risk"))
    own = own.withColumns({"hoeffding": crc_hoeffding(F.col("risk"), F.col("n"), delta), "wilson": crc_wilson(F.col("risk"), F.col("n"), delta)})
    return own.withColumn("risk", F.when(F.col("n") > 0, F.col("risk")).otherwise(1.0)).withColumn("best", F.least("hoeffding", "wilson"))


def conformal_thresholds(rows: DataFrame, score: str, group: list[str], alpha: float = 0.05) -> DataFrame:
    """The group columns and threshold: the ceil((n + 1) (1 - alpha))-th of the ascending scores, the last at most."""
    n = F.col("n")
    place = F.least(n, F.greatest(F.lit(1), F.ceil((n + 1) * F.lit(1 - alpha))))
    return ranks.order_statistics(rows, score, {"threshold": place}, group=group).select(*group, "threshold")
