"""Expressions on arrays and maps of numbers: everything a frame vector needs without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.columns import col_of


def total(c: Column | str) -> Column:
    return F.aggregate(col_of(c), F.lit(0.0), lambda a, x: a + x.cast("double"))


def mean(c: Column | str) -> Column:
    """Mean of the non-null elements; null for none."""
    kept = F.filter(col_of(c), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    return F.try_divide(total(kept), F.size(kept))


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col_of(a), col_of(b), lambda x, y: x.cast("double") * y.cast("double")))


def mse(a: Column | str, b: Column | str) -> Column:
    d = F.zip_with(col_of(a), col_of(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.try_divide(dot(d, d), F.size(d))


def l2(a: Column | str, b: Column | str) -> Column:
    d = F.zip_with(col_of(a), col_of(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(dot(d, d))


def log_sum_exp(c: Column | str) -> Column:
    x = F.transform(col_of(c), lambda v: v.cast("double"))
    top = F.array_max(x)
    return top + F.log(total(F.transform(x, lambda v: F.exp(v - top))))


def finite_all(c: Column | str) -> Column:
    return F.forall(col_of(c), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))


def nll_of(logits: Column | str, target: Column | str) -> Column:
    """-log softmax of the target's logit; null where a logit is missing or not finite or the target is none of them."""
    t = col_of(target)
    value = log_sum_exp(logits) - F.get(col_of(logits), t).cast("double")
    return F.when(finite_all(logits) & (t >= 0) & (t < F.size(col_of(logits))), value)


def sigmoid(c: Column | str) -> Column:
    return 1 / (1 + F.exp(-col_of(c)))


def decay(gap: Column | str, rate: float) -> Column:
    """exp(-gap / rate), 0 where there is no gap."""
    return F.coalesce(F.exp(-col_of(gap) / rate), F.lit(0.0))


def argmax(c: Column | str) -> Column:
    """Zero-based place of the first largest element."""
    return F.array_position(col_of(c), F.array_max(col_of(c))) - 1


def matvec(rows: Column | str, v: Column | str, bias: Column | str | None = None) -> Column:
    """Linear layer: one product per row of the matrix, plus the bias."""
    out = F.transform(col_of(rows), lambda r: dot(r, v))
    return out if bias is None else F.zip_with(out, col_of(bias), lambda x, y: x + y)


def pooled(values: Column | str, by: int) -> Column:
    """Means of whole groups of ``by`` elements; the rest is dropped."""
    v = col_of(values)
    n = F.floor(F.size(v) / by).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: total(F.slice(v, i * by + 1, F.lit(by))) / by)).otherwise(F.array().cast("array<double>"))


def best_action(probabilities: Column | str, out_of_play: list[str]) -> Column:
    """(p, action) of the likeliest entry of a map that is in play; of equal ones the greater name."""
    entries = F.filter(F.map_entries(col_of(probabilities)), lambda e: ~e.key.isin(out_of_play))
    return F.array_max(F.transform(entries, lambda e: F.struct(e.value.alias("p"), e.key.alias("action"))))


def counted(values: Column | str, names: list[str]) -> Column:
    """Map of every name to how often it is among the values, 0 included."""
    v = col_of(values)
    how_often = [F.size(F.filter(v, (lambda n: lambda x: x == n)(n))) for n in names]
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*how_often))
