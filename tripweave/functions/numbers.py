"""Number helpers: guarded ratios, Python-compatible rounding, byte-swap correction."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonzero(c) -> Column:
    """The value, or null when it is 0 (a stored 0 means "not measured")."""
    return F.nullif(col(c), F.lit(0))


def ratio(num, den) -> Column:
    """num / den, null when den is 0 or either side is null."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def finite_or_null(c) -> Column:
    """NaN and infinities become null."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def _round_exact(v: Column, digits: int) -> Column:
    scale = 10 ** digits
    k = F.floor(v * F.lit(float(scale))).cast("double")
    rest = k * 2.0 + 1.0
    bits = 2 * scale
    power = 1 << (bits.bit_length() - 1)
    while power:
        if bits & power:
            rest = rest - v * F.lit(float(power))
        power >>= 1
    # k + 0.25, k + 0.75 or, on a tie, k + 0.5, which rint sends to the even side
    rounded = F.rint(k + 0.5 - F.signum(rest) * 0.25) / F.lit(float(scale))
    return F.when(F.abs(v) < F.lit(2.0 ** 51 / scale), rounded).otherwise(v)


def py_round(c, digits: int = 0, inline: bool = False) -> Column:
    """Round half to even on the exact binary value, as Python's round() does.

    ``2 * 10**digits * v`` is subtracted from the odd tie number ``2k + 1`` one
    power of two at a time.  Every partial difference is exact (the operands are
    within a factor of two), so the sign tells which side of the tie ``v`` is on.

    The formula uses its argument many times.  By default the argument is bound
    once by a lambda, which keeps plans small when rounded columns feed filters
    and further rounding.  ``inline`` writes the formula out, for per-sample
    columns where generated code matters.
    """
    v = col(c).cast("double")
    if inline:
        return _round_exact(v, digits)
    return F.transform(F.array(v), lambda x: _round_exact(x, digits))[0]


def settled(c) -> Column:
    """A sum to nine decimals, so the order of adding cannot move what is derived from it."""
    return py_round(c, 9)


def fixed(c, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded as Python formats it."""
    return F.format_string(f"%.{digits}f", py_round(c, digits))


def swap_correct(value, div, mul, ofs) -> Column:
    """Undo a swapped byte order in a scaled 16-bit reading.

    Readings whose raw form does not fit 16 bits are returned unchanged.
    """
    value, div, mul, ofs = col(value), col(div), col(mul), col(ofs)
    signed = F.rint((value - ofs) * div / mul)
    raw = F.when(signed < 0, signed + 65536.0).otherwise(signed)
    word = F.when(raw.between(0.0, 65535.0), raw).otherwise(0.0).cast("int")
    swapped = F.shiftleft(word.bitwiseAND(255), 8).bitwiseOR(F.shiftright(word, 8).bitwiseAND(255))
    return F.when(raw.between(0.0, 65535.0), swapped * mul / div + ofs).otherwise(value)
