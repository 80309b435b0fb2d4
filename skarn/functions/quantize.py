"""Scalar 8-bit and 1-bit quantization of vectors, as Column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import doubles


def sq8(v: Column) -> Column:
    """struct(data array<tinyint>, scale double): scale is the largest magnitude / 127 (1 for a zero vector); halves
    round up."""
    most = F.coalesce(F.array_max(F.transform(doubles(v), lambda x: F.abs(x))), F.lit(0.0))
    scale = F.when(most == 0, F.lit(1.0)).otherwise(most / 127)
    data = F.transform(doubles(v), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x * (1 / scale) + 0.5))).cast("tinyint"))
    return F.struct(data.alias("data"), scale.alias("scale"))


def sq8_decode(q: Column) -> Column:
    return F.transform(q["data"], lambda x: x.cast("double") * q["scale"])


def sq8_dot(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a["data"], b["data"], lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return total * a["scale"] * b["scale"]


def sq8_distance(a: Column, b: Column) -> Column:
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sq8_dot(a, b)))


def bq(v: Column) -> Column:
    """struct(bits array<bigint>, dimension int): bit i % 32 of word i / 32 is set where the value is over 0."""
    size = F.size(v)
    words = F.sequence(F.lit(0), F.greatest(F.ceil(size / 32).cast("int") - 1, F.lit(0)))

    def word(w: Column) -> Column:
        part = F.slice(doubles(v), w * 32 + 1, F.lit(32))
        return F.aggregate(F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)

    return F.struct(F.transform(words, word).alias("bits"), size.alias("dimension"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits over the words that both have."""
    n = F.least(F.size(a["bits"]), F.size(b["bits"]))
    pairs = F.zip_with(F.slice(a["bits"], F.lit(1), n), F.slice(b["bits"], F.lit(1), n), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def bq_cosine(a: Column, b: Column) -> Column:
    return F.cos(F.lit(math.pi) * hamming(a, b) / a["dimension"])


def bq_distance(a: Column, b: Column) -> Column:
    return hamming(a, b) / a["dimension"]


def bq_decode(q: Column) -> Column:
    unit = 1 / F.sqrt(q["dimension"].cast("double"))
    at = F.sequence(F.lit(0), q["dimension"] - 1)
    bit = lambda i: F.call_function("shiftright", F.element_at(q["bits"], F.floor(i / 32).cast("int") + 1), (i % 32).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return F.transform(at, lambda i: F.when(bit(i) == 1, unit).otherwise(-unit))
