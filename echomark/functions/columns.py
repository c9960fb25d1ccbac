"""Column expressions: hash packing, FNV-1a, quantiles, intervals and exact tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normal quantile of 97.5 % (fixed value).
Z95 = 1.959963984540054


def pack_hash(f1: Column, f2: Column, dt: Column, decim: int = 1, freq_bits: int = 9, dt_bits: int = 14) -> Column:
    """f1, f2 (decimated) and dt in one non-negative 64-bit integer; an error outside their ranges, never a wrap."""
    if decim < 1 or decim & (decim - 1):
        raise ValueError("decim must be a power of two")
    a, b, d = F.floor(f1 / decim).cast("long"), F.floor(f2 / decim).cast("long"), dt.cast("long")
    fits = a.between(0, (1 << freq_bits) - 1) & b.between(0, (1 << freq_bits) - 1) & d.between(0, (1 << dt_bits) - 1)
    packed = F.shiftleft(a, freq_bits + dt_bits) + F.shiftleft(b, dt_bits) + d
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("hash field out of range")).cast("long"))


def unpack_hash(h: Column, decim: int = 1, freq_bits: int = 9, dt_bits: int = 14) -> Column:
    """struct(f1, f2, dt) of a packed hash, frequencies in decimated bins times decim."""
    low = (1 << freq_bits) - 1
    f1 = F.shiftrightunsigned(h, freq_bits + dt_bits).bitwiseAND(F.lit(low).cast("long"))
    f2 = F.shiftrightunsigned(h, dt_bits).bitwiseAND(F.lit(low).cast("long"))
    return F.struct((f1 * decim).alias("f1"), (f2 * decim).alias("f2"), h.bitwiseAND(F.lit((1 << dt_bits) - 1).cast("long")).alias("dt"))


def fnv1a32(text: Column) -> Column:
    """FNV-1a with 32 bits of the UTF-8 bytes, as a long."""
    octets = F.transform(F.filter(F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(octets, F.lit(2166136261).cast("long"), lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(16777619).cast("long"), F.lit(4294967296).cast("long")))


def hazen(values: Column, p: float | Column) -> Column:
    """Interpolated quantile of a sorted array at position p n + 1/2, clamped to its ends."""
    n = F.size(values)
    p = p if isinstance(p, Column) else F.lit(p)
    pos = F.least(F.greatest(n * p + 0.5, F.lit(1.0)), n.cast("double"))
    lo = F.floor(pos).cast("int")
    a, b = F.get(values, lo - 1), F.get(values, F.least(lo, n - 1))
    return F.when(n > 0, a + (pos - lo) * (b - a))


def nearest_rank(values: Column, p: float) -> Column:
    """The ceil(p n)-th of a sorted array, the first at least."""
    n = F.size(values)
    return F.when(n > 0, F.get(values, F.greatest(F.lit(1), F.ceil(n * F.lit(p))).cast("int") - 1))


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """struct(p, lo, hi): a proportion and its Wilson interval, null without trials."""
    p = k.cast("double") / F.nullif(n, F.lit(0))
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    live = n > 0
    return F.struct(F.when(live, p).alias("p"), F.when(live, F.greatest(F.lit(0.0), mid - half)).alias("lo"), F.when(live, F.least(F.lit(1.0), mid + half)).alias("hi"))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided exact p of discordant counts: min(1, 2 P(X <= min(b, c))) for X ~ Bin(b + c, 1/2), by sums of logarithms, which neither overflow nor vanish for large counts."""
    m, k = (b + c).cast("int"), F.least(b, c).cast("int")
    start = F.struct((-m * F.log(F.lit(2.0))).alias("t"), (-m * F.log(F.lit(2.0))).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((m - i + 1).cast("double")) - F.log(i.cast("double"))
        top = F.greatest(acc["s"], t)
        return F.struct(t.alias("t"), (top + F.log(F.exp(acc["s"] - top) + F.exp(t - top))).alias("s"))

    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: F.exp(acc["s"]))
    return F.when(m == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar(n: Column, b: Column, c: Column) -> Column:
    """struct(diff, lo, hi, p, odds): difference of paired proportions (c - b) / n with its Wald interval, exact p, and odds ratio; null without pairs."""
    live = n > 0
    d, m = (c - b) / n, (b + c).cast("double")
    se = F.sqrt(m) / n
    odds = F.when(b > 0, c / b)
    return F.struct(F.when(live, d).alias("diff"), F.when(live, d - Z95 * se).alias("lo"), F.when(live, d + Z95 * se).alias("hi"), F.when(live, mcnemar_p(b, c)).alias("p"), odds.alias("odds"))


def draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
