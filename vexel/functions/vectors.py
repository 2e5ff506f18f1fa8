"""Vector mathematics as column expressions over ARRAY<FLOAT> or ARRAY<DOUBLE> columns, in double precision.

Nothing here leaves the JVM. Distances are lower for nearer vectors; dot product is negated for that reason.
A null vector, or null component, gives null. Vectors of different lengths give null in every function of two vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(v: Col) -> Column:
    return col(v).cast("array<double>")


def total(values: Column) -> Column:
    """The sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _pairwise(a: Col, b: Col, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(doubles(a), doubles(b), f)


def dot(a: Col, b: Col) -> Column:
    return total(_pairwise(a, b, lambda x, y: x * y))


def squared_euclidean(a: Col, b: Col) -> Column:
    return total(_pairwise(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Col, b: Col) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def magnitude(v: Col) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def cosine_similarity(a: Col, b: Col) -> Column:
    """0 where either vector has length zero."""
    norms = magnitude(a) * magnitude(b)
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def cosine_distance(a: Col, b: Col) -> Column:
    return 1.0 - cosine_similarity(a, b)


def dot_distance(a: Col, b: Col) -> Column:
    return -dot(a, b)


def manhattan(a: Col, b: Col) -> Column:
    return total(_pairwise(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Col, b: Col) -> Column:
    return F.array_max(_pairwise(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Col, b: Col, p: float = 2.0) -> Column:
    return F.pow(total(_pairwise(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1.0 / p))


def hamming(a: Col, b: Col, threshold: float = 0.0) -> Column:
    """How many components differ by more than the threshold."""
    return F.size(F.filter(_pairwise(a, b, lambda x, y: F.abs(x - y)), lambda d: d > threshold)).cast("double")


def jaccard(a: Col, b: Col) -> Column:
    """1 - sum of minima / sum of maxima; 0 where the maxima add up to nothing."""
    top = total(_pairwise(a, b, lambda x, y: F.greatest(x, y)))
    return F.when(top <= 0, 0.0).otherwise(1.0 - total(_pairwise(a, b, lambda x, y: F.least(x, y))) / top)


def weighted_euclidean(a: Col, b: Col, weights: Col) -> Column:
    squares = _pairwise(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(total(F.zip_with(squares, doubles(weights), lambda s, w: s * w)))


def _row_product(matrix: Col, v: Column) -> Column:
    return F.transform(col(matrix), lambda row: total(F.zip_with(row, v, lambda m, x: m * x)))


def mahalanobis(a: Col, b: Col, inverse_covariance: Col) -> Column:
    """The inverse covariance is an array of rows."""
    d = _pairwise(a, b, lambda x, y: x - y)
    return F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(d, _row_product(inverse_covariance, d), lambda x, y: x * y))))


def matrix_metric(a: Col, b: Col, matrix: Col) -> Column:
    """Euclidean length of M(a - b)."""
    d = _pairwise(a, b, lambda x, y: x - y)
    return F.sqrt(total(F.transform(_row_product(matrix, d), lambda x: x * x)))


def prefix_euclidean(a: Col, b: Col, n: int = 128) -> Column:
    """Euclidean distance of the first n components."""
    return euclidean(F.slice(doubles(a), 1, n), F.slice(doubles(b), 1, n))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once however often f names it, also within lambdas over components."""
    return F.element_at(F.transform(F.array(value), f), 1)


def wasserstein(a: Col, b: Col) -> Column:
    """Earth mover's distance in one dimension between components, shifted to be positive and scaled to sum 1."""

    def distribution(v: Col) -> Column:
        low = F.least(F.array_min(doubles(v)), F.lit(0.0))
        shifted = _once(low, lambda m: F.transform(doubles(v), lambda x: x - m))
        return _once(shifted, lambda s: _once(total(s), lambda t: F.when(t > 0, F.transform(s, lambda x: x / t)).otherwise(F.transform(s, lambda x: F.lit(1.0) / F.size(s)))))

    gaps = F.zip_with(distribution(a), distribution(b), lambda x, y: x - y)
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    return F.aggregate(gaps, start, lambda s, x: F.struct((s["run"] + x).alias("run"), (s["sum"] + F.abs(s["run"] + x)).alias("sum")))["sum"]


def similarity(distance: Col, metric: str) -> Column:
    """A similarity from a distance of the metric."""
    d = col(distance)
    if metric == "cosine":
        return 1.0 - d
    if metric == "dot":
        return F.greatest(F.lit(0.0), -d)
    return 1.0 / (1.0 + d)


METRICS: dict[str, Callable[[Col, Col], Column]] = {
    "euclidean": euclidean,
    "squared_euclidean": squared_euclidean,
    "cosine": cosine_distance,
    "dot": dot_distance,
    "manhattan": manhattan,
    "chebyshev": chebyshev,
    "hamming": hamming,
    "jaccard": jaccard,
    "minkowski": minkowski,
    "wasserstein": wasserstein,
}


def distance(a: Col, b: Col, metric: str = "euclidean") -> Column:
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}; there are {', '.join(METRICS)}")
    return METRICS[metric](a, b)


def normalize(v: Col) -> Column:
    """The vector scaled to length 1; itself where its length is 0."""
    n = magnitude(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def add(a: Col, b: Col) -> Column:
    return _pairwise(a, b, lambda x, y: x + y)


def subtract(a: Col, b: Col) -> Column:
    return _pairwise(a, b, lambda x, y: x - y)


def multiply(a: Col, b: Col) -> Column:
    return _pairwise(a, b, lambda x, y: x * y)


def scale(v: Col, by: float) -> Column:
    return F.transform(doubles(v), lambda x: x * by)


def divide(v: Col, by: float) -> Column:
    return F.transform(doubles(v), lambda x: x / by)


def density(v: Col) -> Column:
    """The share of components other than zero; null for an empty vector."""
    return F.size(F.filter(doubles(v), lambda x: x != 0)) / F.nullif(F.size(v), F.lit(0))


def zero_fraction(v: Col, threshold: float = 1e-6) -> Column:
    """The share of components no farther from zero than the threshold."""
    return F.size(F.filter(doubles(v), lambda x: F.abs(x) <= threshold)) / F.nullif(F.size(v), F.lit(0))


def entropy(v: Col) -> Column:
    """Base-2 entropy of the components' absolute shares; 0 where they add up to 0."""
    whole = total(F.transform(doubles(v), lambda x: F.abs(x)))
    terms = F.transform(F.filter(doubles(v), lambda x: x != 0), lambda x: -(F.abs(x) / whole) * F.log2(F.abs(x) / whole))
    return F.when(whole == 0, 0.0).otherwise(total(terms))


def query_entropy(v: Col) -> Column:
    """Natural entropy of the components' absolute values over the vector's length."""
    n = magnitude(v)
    terms = F.transform(F.filter(doubles(v), lambda x: x != 0), lambda x: -(F.abs(x) / n) * F.log(F.abs(x) / n))
    return F.when(n == 0, 0.0).otherwise(total(terms))


def quantizability(v: Col) -> Column:
    """1 - distinct components to three places / components."""
    return 1.0 - F.size(F.array_distinct(F.transform(doubles(v), lambda x: F.floor(x * 1000 + 0.5)))) / F.nullif(F.size(v), F.lit(0))


def mean(v: Col) -> Column:
    return total(doubles(v)) / F.nullif(F.size(v), F.lit(0))


def variance(v: Col) -> Column:
    return total(F.transform(doubles(v), lambda x: (x - mean(v)) * (x - mean(v)))) / F.nullif(F.size(v), F.lit(0))


def clusterability(v: Col) -> Column:
    return F.least(F.lit(1.0), variance(v) / (mean(v) * mean(v) + 0.001))


def quality(v: Col) -> Column:
    return F.struct(magnitude(v).alias("magnitude"), density(v).alias("density"), entropy(v).alias("entropy"), quantizability(v).alias("quantizability"), clusterability(v).alias("clusterability"))


def angle(a: Col, b: Col) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine_similarity(a, b))))


def magnitude_ratio(candidate: Col, query: Col) -> Column:
    return F.when(magnitude(query) == 0, F.lit(None)).otherwise(magnitude(candidate) / magnitude(query))


def magnitude_similarity(a: Col, b: Col) -> Column:
    top = F.greatest(magnitude(a), magnitude(b))
    return F.when(top == 0, 1.0).otherwise(F.least(magnitude(a), magnitude(b)) / top)


def center(a: Col, b: Col) -> Column:
    return _pairwise(a, b, lambda x, y: (x + y) / 2)


def box_volume(a: Col, b: Col, flat: bool = True) -> Column:
    """The volume of the box the two vectors span; without `flat`, of its sides that have a length, null if none has."""
    sides = _pairwise(a, b, lambda x, y: F.abs(x - y))
    volume = lambda s: F.aggregate(s, F.lit(1.0), lambda p, x: p * x)
    if flat:
        return volume(sides)
    return F.when(F.exists(sides, lambda x: x > 0), volume(F.filter(sides, lambda x: x != 0)))


def bounding_box(a: Col, b: Col) -> Column:
    return F.struct(_pairwise(a, b, lambda x, y: F.least(x, y)).alias("low"), _pairwise(a, b, lambda x, y: F.greatest(x, y)).alias("high"))


def same_orthant(a: Col, b: Col) -> Column:
    return F.forall(_pairwise(a, b, lambda x, y: x * y), lambda x: x >= 0)


def topology(a: Col, b: Col) -> Column:
    t = angle(a, b)
    return F.when(t < 0.1, "dense").when(t > 2.0, "sparse").otherwise("general")


def confidence(distance: Col) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - col(distance))


def list_confidence(distance: Col) -> Column:
    """As confidence, but over distances up to 10."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - col(distance) / 10.0))


def binary_words(v: Col) -> Column:
    """The bits `component > 0`, packed 32 to a long."""
    bits = F.transform(doubles(v), lambda x: F.when(x > 0, 1).otherwise(0).cast("long"))
    starts = F.sequence(F.lit(1), F.size(v), F.lit(32))
    return F.transform(starts, lambda s: F.aggregate(F.slice(bits, s, 32), F.lit(0).cast("long"), lambda a, b: a * 2 + b))


def binary_hamming(a: Col, b: Col) -> Column:
    """How many bits differ between two arrays of words."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
