"""Vector expressions on array columns; all JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal_vector(v: Sequence[float]) -> Column:
    """A constant vector of doubles."""
    return F.array(*(F.lit(float(x)) for x in v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, missing: float | None = None) -> Column:
    """Cosine similarity; missing (default null) for null vectors, unequal lengths or zero norms."""
    sound = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(sound, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(missing).cast("double"))


def similarity(column: Column, query: Sequence[float], digits: int = 6) -> Column:
    """Rounded cosine similarity to a constant query; rounding makes ranks the same in any summation order."""
    length = sum(float(x) ** 2 for x in query) ** 0.5
    q = literal_vector(query)
    sound = column.isNotNull() & (F.size(column) == len(query)) & (norm(column) > 0)
    return F.when(sound & F.lit(length > 0), F.round(dot(column, q) / (norm(column) * F.lit(length)), digits))


def fit_dimension(a: Column, dim: int) -> Column:
    """The first dim components, null if there are fewer."""
    return F.when(F.size(a) >= dim, F.slice(a, 1, dim))


def mean_vector(vectors: Column) -> Column:
    """The component-wise mean of an array of equally long vectors."""
    first = F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0))
    total = F.aggregate(vectors, first, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.when(F.size(vectors) > 0, F.transform(total, lambda x: x / F.size(vectors)))


def parse_embedding(raw: Column) -> Column:
    """A vector from a JSON array or comma-separated numbers, null if any part is no number."""
    parts = F.split(F.regexp_replace(raw, r"[\[\]\s]", ""), ",")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when(raw.isNotNull() & (F.length(F.trim(raw)) > 0) & ~F.exists(numbers, lambda x: x.isNull()), numbers)


def mean_vectors(df: DataFrame, keys: Sequence[str], vec_col: str = "embedding") -> DataFrame:
    """(keys..., mean): the component-wise mean of each group's vectors. Components are summed in every task before
    anything is shuffled, so a group of any size costs a row for each component and task."""
    parts = df.select(*keys, F.posexplode(vec_col).alias("__k", "__x")).groupBy(*keys, "__k").agg(F.avg(F.col("__x").cast("double")).alias("__x"))
    return parts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__k", "__x"))), lambda x: x["__x"]).alias("mean"))
