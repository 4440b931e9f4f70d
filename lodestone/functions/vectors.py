"""Vector and fingerprint expressions on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value) with value computed once; an expression named inside a lambda would be computed for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)


def average_hash(grid: Column) -> Column:
    """Bits: cell above the mean of all cells."""
    return let(mean(grid), lambda m: F.transform(grid, lambda x: x.cast("double") > m))


def gradient_hash(grid: Column, width: int = 8) -> Column:
    """Bits: cell greater than its left neighbour; each row gives width - 1 bits."""
    pairs = F.filter(F.sequence(F.lit(1), F.size(grid)), lambda i: i % width != 1)
    return F.transform(pairs, lambda i: F.element_at(grid, i) > F.element_at(grid, i - 1))


def bit_similarity(a: Column, b: Column) -> Column:
    return 1.0 - F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)) / F.size(a)


def standardised(grid: Column) -> Column:
    """(x - mean) / population deviation, deviation 1 where it is below 1e-4."""
    centred = let(mean(grid), lambda m: F.transform(grid, lambda x: x.cast("double") - m))
    spread = lambda c: F.sqrt(dot(c, c) / F.size(c))
    return let(centred, lambda c: let(F.when(spread(c) > 1e-4, spread(c)).otherwise(1.0), lambda sd: F.transform(c, lambda x: x / sd)))


def cross_correlation(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / F.size(a)))


def histogram(grid: Column, bins: int = 16, lo: float = -1.0, hi: float = 1.0) -> Column:
    """Density per bin over [lo, hi]; the last bin holds hi."""
    width = (hi - lo) / bins
    inside = F.filter(grid, lambda x: (x >= lo) & (x <= hi))
    slots = F.transform(inside, lambda x: F.least(F.lit(bins - 1), F.floor((x.cast("double") - lo) / width)))
    return let(slots, lambda slot: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(slot, lambda s: s == b)) / (F.greatest(F.lit(1), F.size(slot)) * width)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays mapped to 0..1; 0.5 where it is undefined."""
    centred = lambda v: let(mean(v), lambda m: F.transform(v, lambda x: x - m))

    def of(p: Column) -> Column:
        scale = F.sqrt(dot(p["a"], p["a"]) * dot(p["b"], p["b"]))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.when(scale > 0, dot(p["a"], p["b"]) / scale).otherwise(0.0) + 1.0) / 2.0))

    return let(F.struct(centred(a).alias("a"), centred(b).alias("b")), of)


def visual_similarity(d: Column, n: Column, a: Column, c: Column) -> Column:
    """Weighted mean of gradient hash, cross-correlation, average hash and colour similarities."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.35 * d + 0.35 * n + 0.15 * a + 0.15 * c))


def hash_slots(text: Column, dim: int = 384) -> Column:
    """Terms of the hash embedding: array of (slot, value) for each white-space word at its place."""
    modulus = (1 << 64) % dim
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 0)

    def term(w: Column, i: Column) -> Column:
        h = F.md5(w)
        part = lambda at: F.conv(F.substring(h, at, 16), 16, 10).cast("decimal(20,0)") % dim
        slot = ((part(1) * modulus + part(17)) % dim).cast("int")
        odd = F.conv(F.substring(h, 32, 1), 16, 10).cast("int") % 2
        return F.struct(slot.alias("slot"), (F.when(odd == 0, 1.0).otherwise(-1.0) / F.sqrt(i + 1.0)).alias("value"))

    return F.transform(words, term)


def colour_histogram(channels: list[Column], bins: int = 16, lo: float = -1.0, hi: float = 1.0) -> Column:
    """Densities of each channel, one after another: 16 bins of three channels are 48 values."""
    return F.concat(*[histogram(c, bins, lo, hi) for c in channels])


def gradient_hex(grid: Column, width: int = 9) -> Column:
    """Bits "cell greater than its right neighbour" in hex digits of four, the first bit of a digit counting 1."""
    bits = F.transform(F.filter(F.sequence(F.lit(1), F.size(grid)), lambda i: i % width != 0), lambda i: (F.element_at(grid, i) > F.element_at(grid, i + 1)).cast("int"))
    digit = lambda b, i: F.lower(F.hex(sum((F.element_at(b, i * 4 + k + 1) * 2**k for k in range(1, 4)), F.element_at(b, i * 4 + 1)).cast("long")))
    return let(bits, lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.size(b) / 4).cast("int") - 1), lambda i: digit(b, i)), ""))
