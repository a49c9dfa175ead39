"""Similarity kernels as column expressions: trigram vectors, cosine, token Dice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orelink.functions import vocabulary as V
from orelink.functions.text import bound, literal_map, round_half_up

DIMENSIONS = 256


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), F.trim(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", " ")), F.lit(" "))
    return bound(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))


def counted(values: Column) -> Column:
    """The distinct values of an array as a map value -> count, in order of first occurrence."""
    return bound(values, lambda v: bound(F.array_distinct(v), lambda d: F.map_from_arrays(d, F.transform(d, lambda x: F.size(v) - F.size(F.array_remove(v, x))))))


def fnv1a(gram: Column) -> Column:
    """FNV-1a, 32 bits, of a three-character ASCII string."""
    h = F.lit(2166136261).cast("long")
    for i in (1, 2, 3):
        h = (h.bitwiseXOR(F.ascii(F.substr(gram, F.lit(i), F.lit(1))).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295))
    return h


def embedding(text: Column) -> Column:
    """Counts of hashed trigrams as a sparse map slot -> count."""
    return counted(F.array_sort(F.transform(trigrams(text), lambda g: F.pmod(fnv1a(g), F.lit(DIMENSIONS)).cast("int"))))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(vector), F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine of sparse vectors as a score of 0..100."""
    dot = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.try_element_at(a, k) * F.coalesce(F.try_element_at(b, k), F.lit(0)))
    return F.coalesce(round_half_up(F.try_divide(dot, norm_a * norm_b) * 100), F.lit(0))


def cosine_dense(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def fuzzy_tokens(description: Column) -> Column:
    """Token multiset with stop words dropped, equivalents unified and pressure classes folded."""
    words = F.filter(F.split(F.regexp_replace(F.upper(description), "[^A-Z0-9#]+", " "), " "), lambda t: (F.length(t) >= 2) & ~t.isin(V.STOPWORDS))
    unified = F.array_join(F.transform(words, lambda t: F.coalesce(F.try_element_at(literal_map(V.EQUIVALENTS), t), t)), " ")
    folded = F.regexp_replace(unified, r"(?<![^ ])(?:CL|CLASS) (\d{2,4})(?![^ ])", "CLASS_$1")
    folded = F.regexp_replace(folded, r"(?<![^ ])(?:CL|CLASS)#?(\d{2,4})(?![^ ])", "CLASS_$1")
    folded = F.regexp_replace(folded, r"(?<![^ ])(\d{2,4})#(?![^ ])", "CLASS_$1")
    return F.filter(F.split(folded, " "), lambda t: t != "")


def dice(unique_a: Column, unique_b: Column, size_a: Column, size_b: Column) -> Column:
    shared = F.size(F.array_intersect(unique_a, unique_b))
    return F.when((size_a == 0) | (size_b == 0), 0).otherwise(round_half_up(shared * 200 / F.nullif(size_a + size_b, F.lit(0))))


def distinctive_tokens(text: Column) -> Column:
    words = F.split(F.upper(text), "[^A-Z0-9#]+")
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 2) & ~t.isin(V.STOPWORDS) & ~t.rlike(r"^\d+$")))
