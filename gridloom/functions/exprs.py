"""Column builders: integer codings, predictors, colour and rotation transforms, cell and curve keys."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG = "bigint"


def _c(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def zigzag(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast(LONG)))


def bitlen(z: Column) -> Column:
    """Bits that a non-negative integer needs; 0 for 0, and 64 for what has the sign bit set."""
    # half more than z is never so near a power of two that the logarithm rounds across it
    small = F.floor(F.log2(z + F.lit(0.5))) + 1
    return F.when((z >= 0) & (z < (1 << 44)), small).otherwise(F.length(F.bin(z))).cast("int")


def bucket(z: Column, most: int = 23) -> Column:
    return F.least(bitlen(z), F.lit(most))


def wrap(v: Column) -> Column:
    """A decimal brought into 64 bits, modulo 2**64."""
    m = F.lit(Decimal(1 << 64)).cast("decimal(38,0)")
    r = v - F.floor(v / m).cast("decimal(38,0)") * m
    r = F.when(r < 0, r + m).when(r >= m, r - m).otherwise(r)
    return F.when(r >= F.lit(Decimal(1 << 63)).cast("decimal(38,0)"), r - m).otherwise(r).cast(LONG)


def _low(v: Column) -> Column:
    return v.bitwiseAND(F.lit(0xFFFFFFFF))


def wsub(a: Column, b: Column) -> Column:
    """a - b modulo 2**64, by halves of 32 bits, so that nothing overflows on the way. Arguments should be columns:
    each stands in the result three times."""
    low = _low(a) - _low(b)
    return F.shiftleft(F.shiftright(a, 32) - F.shiftright(b, 32) + F.shiftright(low, 32), 32).bitwiseOR(_low(low))


def wadd(a: Column, b: Column) -> Column:
    low = _low(a) + _low(b)
    return F.shiftleft(F.shiftright(a, 32) + F.shiftright(b, 32) + F.shiftright(low, 32), 32).bitwiseOR(_low(low))


def floor_div(a: Column, b: Column | int) -> Column:
    b = _c(b).cast(LONG)
    return F.call_function("div", a - F.pmod(a, b), b).cast(LONG)


def round_div(a: Column, b: Column | int) -> Column:
    """Quotient rounded to nearest, halves away from zero, for positive b."""
    b = _c(b).cast(LONG)
    half = F.abs(a) + floor_div(b, 2)
    q = floor_div(half, b)
    return F.when(a >= 0, q).otherwise(-q)


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def median5(*v: Column) -> Column:
    return F.element_at(F.array_sort(F.array(*v)), 3)


def drop_bits(v: Column, k: int) -> Column:
    """The k low bits rounded away."""
    return v if k == 0 else F.shiftright(v + F.lit(1 << (k - 1)).cast(LONG), k)


def quantize(x: Column, step: float) -> Column:
    """Nearest multiple of step as an integer, halves away from zero."""
    return F.round(x / F.lit(step)).cast(LONG)


def quantize_even(x: Column, step: float) -> Column:
    return F.rint(x / F.lit(step)).cast(LONG)


def width_bytes(span: Column) -> Column:
    """Bytes of an unsigned offset up to span: 0, 1, 2, 4 or 8."""
    return F.when(span == 0, 0).when(span < (1 << 8), 1).when(span < (1 << 16), 2).when(span < (1 << 32), 4).otherwise(8)


def polar(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    r = F.sqrt(x * x + y * y + z * z)
    up = F.when(r > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / r))).otherwise(0.0)
    return r, F.atan2(y, x), F.asin(up)


def unpolar(r: Column, azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    flat = r * F.cos(elevation)
    return flat * F.cos(azimuth), flat * F.sin(azimuth), r * F.sin(elevation)


def world(kind: str, x: Column, y: Column, z: Column, scale=(1.0, 1.0, 1.0), offset=(0.0, 0.0, 0.0), r_step: float = 1.0, angle_step: float = 1.0) -> tuple[Column, Column, Column]:
    """World coordinates of an integer (scaled and moved), float (as they stand) or polar (range, azimuth and elevation in
    steps) representation."""
    if kind == "int":
        return tuple(v * F.lit(s) + F.lit(o) for v, s, o in zip((x, y, z), scale, offset, strict=True))
    if kind == "float":
        return x.cast("double"), y.cast("double"), z.cast("double")
    if kind == "polar":
        return unpolar(x * F.lit(r_step), y * F.lit(angle_step), z * F.lit(angle_step))
    raise ValueError(f"no representation {kind}")


def byte_plane(z: Column, k: int) -> Column:
    """Byte k of a 64-bit integer, the lowest first."""
    return F.shiftright(z, 8 * k).bitwiseAND(F.lit(255).cast(LONG))


def hash_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a digest of key and seed."""
    digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def ycocg(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    co = r - b
    t = b + F.shiftright(co, 1)
    cg = g - t
    return t + F.shiftright(cg, 1), co, cg


def unycocg(y: Column, co: Column, cg: Column) -> tuple[Column, Column, Column]:
    t = y - F.shiftright(cg, 1)
    b = t - F.shiftright(co, 1)
    return b + co, cg + t, b


def shear(x: Column, y: Column, t: int, s: int, bits: int = 20) -> tuple[Column, Column]:
    """A reversible rotation of the integer plane by three shears; t and s are fixed-point factors."""
    x1 = x + F.shiftright(F.lit(t).cast(LONG) * y, bits)
    y1 = y + F.shiftright(F.lit(s).cast(LONG) * x1, bits)
    return x1 + F.shiftright(F.lit(t).cast(LONG) * y1, bits), y1


def unshear(x: Column, y: Column, t: int, s: int, bits: int = 20) -> tuple[Column, Column]:
    x1 = x - F.shiftright(F.lit(t).cast(LONG) * y, bits)
    y1 = y - F.shiftright(F.lit(s).cast(LONG) * x1, bits)
    return x1 - F.shiftright(F.lit(t).cast(LONG) * y1, bits), y1


def spread3(v: Column, bits: int = 21) -> Column:
    """Every bit of v moved to three times its place."""
    one = F.lit(1).cast(LONG)
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(v, k).bitwiseAND(one), 3 * k) for k in range(bits)])


def morton(x: Column, y: Column, z: Column, bits: int = 21, x_low: bool = True) -> Column:
    """Interleaved bits; x_low: x takes the lowest bit of each three, otherwise the highest."""
    a, b, c = (x, y, z) if x_low else (z, y, x)
    return spread3(a, bits).bitwiseOR(F.shiftleft(spread3(b, bits), 1)).bitwiseOR(F.shiftleft(spread3(c, bits), 2))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast(LONG)


def return_class(number: Column, total: Column) -> Column:
    """0: single, 1: first, 2: last, 3: middle."""
    return F.when(total <= 1, 0).when(number <= 1, 1).when(number >= total, 2).otherwise(3)


def unpack_flags(bits: Column) -> dict[str, Column]:
    """The packed return, direction, edge, class and channel bits of a scan record."""
    part = lambda shift, width: F.shiftright(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return {"return_number": part(0, 4), "number_of_returns": part(4, 4), "scan_direction": part(8, 1), "edge": part(9, 1), "class_flags": part(10, 4), "channel": part(14, 2)}


def pack_flags(rn: Column, nr: Column, direction: Column, edge: Column, flags: Column, channel: Column) -> Column:
    fields = ((rn, 0), (nr, 4), (direction, 8), (edge, 9), (flags, 10), (channel, 14))
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(f.cast(LONG), k) for f, k in fields])


def mean_round(total: Column, count: Column) -> Column:
    """Integer mean, halves away from zero."""
    return F.when(total >= 0, F.floor((2 * total + count) / (2 * count))).otherwise(-F.floor((-2 * total + count) / (2 * count))).cast(LONG)


def octahedral(nx: Column, ny: Column, nz: Column, levels: int = 255) -> tuple[Column, Column]:
    """A unit vector as two integers from 0 to levels, on the unfolded octahedron."""
    s = F.abs(nx) + F.abs(ny) + F.abs(nz)
    ox, oy = nx / s, ny / s
    sign = lambda c: F.when(c >= 0, 1.0).otherwise(-1.0)
    u = F.when(nz >= 0, ox).otherwise((1 - F.abs(oy)) * sign(ox))
    v = F.when(nz >= 0, oy).otherwise((1 - F.abs(ox)) * sign(oy))
    return tuple(F.floor((x + 1) * (levels / 2) + 0.5).cast("int") for x in (u, v))


def from_octahedral(u: Column, v: Column, levels: int = 255) -> tuple[Column, Column, Column]:
    """The unit vector in the middle of a code's cell."""
    x, y = u * F.lit(2.0 / levels) - 1, v * F.lit(2.0 / levels) - 1
    z = 1 - F.abs(x) - F.abs(y)
    sign = lambda c: F.when(c >= 0, 1.0).otherwise(-1.0)
    a, b = F.when(z >= 0, x).otherwise((1 - F.abs(y)) * sign(x)), F.when(z >= 0, y).otherwise((1 - F.abs(x)) * sign(y))
    r = F.sqrt(a * a + b * b + z * z)
    return a / r, b / r, z / r


#: Shares of a dropped bit that is saved, above which the bit was noise, mostly noise or structure (fixed values).
BIT_VERDICTS = ((0.92, "noise"), (0.70, "mostly noise"), (0.40, "structure"))
#: Bits a level of an octree, above which the level is noise, sampling or structure (fixed values).
LEVEL_VERDICTS = ((2.85, "noise"), (2.2, "sampling"), (1.2, "structure"))


def verdict(v: Column, steps: tuple[tuple[float, str], ...], last: str = "strong structure") -> Column:
    out = F.when(v > steps[0][0], steps[0][1])
    for limit, name in steps[1:]:
        out = out.when(v > limit, name)
    return F.when(v.isNotNull(), out.otherwise(last))


#: Trend terms by name: added to a neighbour that was chosen as the prediction.
TRENDS = ("none", "median3", "half")


def trend(name: str, d: list[Column], k: Column) -> Column:
    """What to add, from the last three differences (latest first) and the number k of rows before; 0 until three
    differences between rows are known."""
    zero = F.lit(0).cast(LONG)
    m = F.when(k >= 4, median3(*d[:3])).otherwise(zero)
    return {"none": zero, "median3": m, "half": F.floor(m / 2).cast(LONG)}[name]


#: The eight predictors by name, in the order of their numbers.
MODES = ("median3", "mean4", "half", "median5", "quarter", "three_quarter", "none", "median5_half")


def predicted(mode: int, prev: Column, d: list[Column], k: Column) -> Column:
    """Prediction from the value before and the last five differences d[0..4] (latest first); k rows came
    before. The first row's difference is its value itself. Missing differences fall back to the latest."""
    zero = F.lit(0).cast(LONG)
    d0 = F.when(k >= 1, d[0]).otherwise(zero)
    med3 = F.when(k >= 3, median3(d[0], d[1], d[2])).otherwise(d0)
    med5 = F.when(k >= 6, median5(*d)).otherwise(med3)
    step = {
        0: med3,
        1: F.when(k >= 5, F.floor((d[0] + d[1] + d[2] + d[3]) / 4).cast(LONG)).otherwise(d0),
        2: F.floor(d0 / 2).cast(LONG),
        3: med5,
        4: F.floor(d0 / 4).cast(LONG),
        5: F.floor(d0 * 3 / 4).cast(LONG),
        6: zero,
        7: F.when(k >= 6, F.floor(median5(*d) / 2).cast(LONG)).otherwise(F.floor(d0 / 2).cast(LONG)),
    }[mode]
    return F.when(k >= 1, prev).otherwise(zero) + step
