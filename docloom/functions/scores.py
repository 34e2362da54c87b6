"""Score columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_score(score: Column) -> Column:
    """A similarity in 0..1 as it is; (1, 2] as a distance (1 - s, not below 0); above as 1 / (1 + s); else 0."""
    s = score.cast("string").try_cast("double")
    return F.when(s.isNull() | F.isnan(s) | (s < 0), 0.0).when(s <= 1, s).when(s <= 2, F.greatest(F.lit(0.0), 1 - s)).otherwise(1 / (1 + s))


def first_truthy(*scores: Column) -> Column:
    """The first that is neither NULL nor 0; 0 if there is none."""
    return F.coalesce(*(F.nullif(s, F.lit(0.0)) for s in scores), F.lit(0.0))


def gate_score(similarity: Column, original: Column, meta_vector: Column, vector: Column, bm25: Column, final: Column, rrf: Column) -> Column:
    """Evidence score of a hit: the best of the cosine scores if any is above 0, else of all others."""
    best = F.greatest(*(normalise_score(x) for x in (original, meta_vector, vector)))
    return F.when(best > 0, best).otherwise(F.greatest(*(normalise_score(x) for x in (similarity, bm25, final, rrf))))


def public_score(similarity: Column, meta_vector: Column, vector: Column, original: Column) -> Column:
    """First of the candidates that is above 0 after normalisation."""
    return first_truthy(*(normalise_score(x) for x in (similarity, meta_vector, vector, original)))


def percent(part: Column, whole: Column) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)) * 100, 2)


def coerce_id(value: Column) -> Column:
    """Ids as text: trimmed; integers without leading zeros; '-1' for NULL."""
    t = F.trim(value)
    return F.when(value.isNull(), "-1").otherwise(F.coalesce(F.when(t.rlike(r"^-?[0-9]+$"), t.try_cast("bigint").cast("string")), t))


def coerce_page(value: Column) -> Column:
    t = F.trim(value)
    return F.when(t.rlike(r"^-?[0-9]{1,9}$"), t.try_cast("int"))


def display_score(original: Column, vector: Column, rrf: Column, bm25: Column) -> Column:
    """What is shown for a hit: the first score that is a number other than 0; 0 if there is none."""
    return first_truthy(*(x.cast("string").try_cast("double") for x in (original, vector, rrf, bm25)))


def backoff_seconds(attempt: Column, base: float = 0.25, factor: float = 2.0, most: float = 2.5) -> Column:
    """Wait before a retry; the first has the number 0."""
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(most))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double; 0 if one of them is a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)
