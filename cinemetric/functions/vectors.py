"""Vector column functions on ``array<double>`` (JVM higher-order functions).

Spark 4.1 has no built-in dense-vector arithmetic on arrays, so these are
``transform`` / ``zip_with`` / ``aggregate`` expressions.  For wide vectors in
hot loops the operators offer an Arrow/NumPy path as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v) -> Column:
    """``v / ||v||``; a zero vector is returned unchanged."""
    n = norm(v)
    return F.when(n == 0, _c(v)).otherwise(F.transform(_c(v), lambda x: x / n))


def cosine100(a, b) -> Column:
    """100 x cosine similarity (the logit scale of zero-shot scoring)."""
    return F.lit(100.0) * dot(l2_normalize(a), l2_normalize(b))


def softmax(v) -> Column:
    m = F.array_max(_c(v))
    e = F.transform(_c(v), lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def logsumexp(v) -> Column:
    m = F.array_max(_c(v))
    return m + F.log(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def log_softmax(v) -> Column:
    lse = logsumexp(v)
    return F.transform(_c(v), lambda x: x - lse)


def argmax(v) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(_c(v), F.array_max(_c(v))) - 1).cast("int")


def scale(v, mean, sd) -> Column:
    """``(x - mean) / sd`` per dimension; ``mean``/``sd`` are array columns or literals."""
    return F.zip_with(F.zip_with(_c(v), _c(mean), lambda x, m: x - m), _c(sd), lambda d, s: d / s)


def kl_divergence(log_target, log_input) -> Column:
    """``sum(exp(t) * (t - i))`` for log-probability arrays (KL(target || input))."""
    return F.aggregate(F.zip_with(_c(log_target), _c(log_input), lambda t, i: F.exp(t) * (t - i)),
                       F.lit(0.0), lambda acc, x: acc + x)
