"""Dense vectors as ARRAY<DOUBLE> columns: closed forms over higher-order functions, null where an input is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """v / |v|; unchanged if the norm is below 1e-12."""
    n = norm(a)  # repeated as an array, for a lambda would compute it again at each element
    return F.when(n < TINY, a).otherwise(F.zip_with(a, F.array_repeat(n, F.size(a)), lambda x, m: x / m))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is below 1e-12."""
    return F.when((norm(a) < TINY) | (norm(b) < TINY), F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def cosine_eps(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + TINY)


def semantic(f: Column, b: Column) -> Column:
    return F.zip_with(f, b, lambda x, y: (x + y) / 2)


def causal(f: Column, b: Column) -> Column:
    return F.zip_with(f, b, lambda x, y: (x - y) / 2)


def gamma(fi: Column, bi: Column, fj: Column, bj: Column) -> Column:
    """Directional score: f_i . b_j - s_i . s_j."""
    return dot(fi, bj) - dot(semantic(fi, bi), semantic(fj, bj))


def gamma_sym(fi: Column, bi: Column, fj: Column, bj: Column) -> Column:
    return -dot(causal(fi, bi), causal(fj, bj))


def gamma_anti(fi: Column, bi: Column, fj: Column, bj: Column) -> Column:
    return dot(causal(fi, bi), semantic(fj, bj)) - dot(causal(fj, bj), semantic(fi, bi))


def squared_distance(a: Column, b: Column) -> Column:
    return dot(a, a) + dot(b, b) - 2 * dot(a, b)


def direction_strength(anti: Column, ci: Column, cj: Column) -> Column:
    """|anti| against the causal parts' norms; 0 where their product is at most 1e-9."""
    both = norm(ci) * norm(cj)
    return F.when(both > 1e-9, F.abs(anti) / (both + 1e-9)).otherwise(F.lit(0.0))


def signed_weight(edge_type: Column, x: Column) -> Column:
    """Negative types weigh -|x|, others x, or |x| / 2 where x isn't positive."""
    return F.when(edge_type.isin("contradicts", "superseded"), -F.abs(x)).when(x > 0, x).otherwise(F.abs(x) * 0.5)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


# Prompts and weights that hash vectors depend on.
FORWARD_PROMPT = "Forward describe — what comes next or follows from: "
BACKWARD_PROMPT = "Backward describe — what came before or causes: "
HASH_SHARES = 0.7, 0.3


def hash_period(prompt: str, text: Column, seed: int) -> Column:
    """The eight little-endian 32-bit words of a SHA-256, scaled to -1 .. 1."""
    h = F.sha2(F.concat(F.lit(f"{prompt}::"), text, F.lit(f"::{seed}")), 256)
    word = lambda k: F.conv(F.concat(*[F.substring(h, 8 * k + 2 * b + 1, 2) for b in (3, 2, 1, 0)]), 16, 10).cast("double")
    return F.array(*[word(k) / (2**32 - 1) * 2 - 1 for k in range(8)])
