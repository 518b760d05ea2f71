"""Scalar helpers as Column expressions: 32-bit hashes on longs, logarithms, and the usual functors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = 0xFFFFFFFF


def _cut(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_WORD))


def _left(x: Column, n: int) -> Column:
    return _cut(F.shiftleft(x, n))


def log2_up(x: Column) -> Column:
    """The smallest k with 2**k >= x; 0 for x <= 1."""
    return F.when(x <= 1, F.lit(0)).otherwise(F.length(F.bin(x - 1))).cast("long")


# The rounds of the 32-bit mix (constant, how it is put in, how the shifted word is put in, shift; left is positive).
MIX = [
    (0x7ED55D16, "add", "add", 12),
    (0xC761C23C, "xor", "xor", -19),
    (0x165667B1, "add", "add", 5),
    (0xD3A2646C, "add", "xor", 9),
    (0xFD7046C5, "add", "add", 3),
    (0xB55A4F09, "xor", "xor", -16),
]
# The linear congruence of the second hash.
_FACTOR, _STEP, _MODULUS = 1103515245, 12345, 0xFFFFFFFF


def _put(how: str, a: Column, b: Column) -> Column:
    return _cut(a + b) if how == "add" else a.bitwiseXOR(b)


def hash32(x: Column) -> Column:
    """The 32-bit mix of the low word of ``x``, as a long from 0 to 2**32 - 1.

    Each round uses its input twice, so rounds are folded over an array instead
    of being nested, which would double the expression each time.
    """
    def round_of(constant: int, put_in: str, put_shifted: str, shift: int):
        def mixed(v: Column) -> Column:
            shifted = _left(v, shift) if shift > 0 else F.shiftright(v, -shift)
            return _put(put_shifted, _put(put_in, v, F.lit(constant)), shifted)

        return mixed

    out = F.array(_cut(x.cast("long")))
    for step in MIX:
        out = F.transform(out, round_of(*step))
    return out[0]


def hash_int(x: Column) -> Column:
    """``hash32`` without its highest bit."""
    return hash32(x).bitwiseAND(F.lit(_WORD >> 1))


def hash2(x: Column) -> Column:
    """The linear congruence of the low word of ``x``, modulo 2**32 - 1."""
    return _cut(F.lit(_FACTOR).cast("long") * _cut(x.cast("long")) + _STEP) % F.lit(_MODULUS)


def identity(x: Column) -> Column:
    return x


def add(x: Column, y: Column) -> Column:
    return x + y


def absolute(x: Column) -> Column:
    return F.abs(x)


def zero(x: Column) -> Column:
    return F.lit(0)


def larger(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def smaller(x: Column, y: Column) -> Column:
    return F.least(x, y)


def first(pair: Column) -> Column:
    return pair["first"]


def second(pair: Column) -> Column:
    return pair["second"]


def non_negative(x: Column) -> Column:
    return x >= 0


def always(x: Column) -> Column:
    return F.lit(True)


def require(condition: Column, message: str) -> Column:
    """True, or an error that stops the job."""
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
