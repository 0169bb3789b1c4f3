"""Vector arithmetic on array<float> columns; sums are taken in double, in element order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero; vectors of unlike length raise an error."""
    size = norm(a) * norm(b)
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("dimension mismatch")).cast("double"))
    return checked.otherwise(F.when(size == 0, 0.0).otherwise(dot(a, b) / size))


def unit(a: Column, scale: float = 1.0) -> Column:
    """``scale`` times the unit vector, in double; the zero vector stays.

    The length is taken once a vector, not once an element.
    """
    scaled = lambda b: F.transform(b["v"], lambda x: F.when(b["n"] == 0, x.cast("double")).otherwise(F.lit(scale) * x.cast("double") / b["n"]))
    return F.get(F.transform(F.array(F.struct(a.alias("v"), norm(a).alias("n"))), scaled), F.lit(0))


def normalized(a: Column) -> Column:
    """Unit length, stored as float; the zero vector stays."""
    return unit(a).cast("array<float>")


def character_sums(text: Column, dimensions: int) -> Column:
    """Character codes summed by place modulo ``dimensions``: whole numbers, in double."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))

    def sums(own: Column) -> Column:
        at = lambda p: F.filter(own, lambda _, i: i % dimensions == p)
        return F.transform(places, lambda p: F.aggregate(at(p), F.lit(0.0), lambda s, c: s + F.ascii(c).cast("double")))

    # An array of one binds the letters, which are then split off once and not for each place.
    return F.get(F.transform(F.array(letters), sums), F.lit(0))


def hash_embedding(text: Column, dimensions: int = 3) -> Column:
    """A deterministic stand-in for an embedder: ``character_sums`` at unit length, stored as float."""
    return normalized(character_sums(text, dimensions))
