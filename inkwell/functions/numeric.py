"""Numeric helpers with the analyses' null semantics (see SURVEY §4.3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(num, den) -> Column:
    """a / b, null when b is 0 or null (never inf/NaN, never an ANSI error)."""
    return F.try_divide(_c(num), _c(den))


def percent(num, den) -> Column:
    """Share on the 0-100 scale, unrounded."""
    return safe_div(num, den) * F.lit(100.0)


def percent_round(x, digits: int = 1) -> Column:
    """x * 100 rounded half-to-even (R's ``round``)."""
    return F.bround(_c(x) * F.lit(100.0), digits)


def js_round(x) -> Column:
    """Rounding half toward +infinity, as JavaScript's Math.round; returns bigint."""
    return F.floor(_c(x) + F.lit(0.5))


def decade(year) -> Column:
    """floor(year / 10) * 10 as int; null stays null."""
    return (F.floor(_c(year) / F.lit(10)) * F.lit(10)).cast("int")


def strict_sum(x) -> Column:
    """Sum that is null as soon as any input is null (R's sum without na.rm)."""
    x = _c(x)
    return F.when(F.count(F.lit(1)) == F.count(x), F.sum(x))


def round6(x) -> Column:
    """Final rounding of reported doubles (keeps oracle hashes stable)."""
    return F.round(_c(x), 6)


# Odd multiplier and mask of the 32-bit key scramble below.
MIX_MULTIPLIER = 1540483477
MASK32 = 0xFFFFFFFF


def mix32(key, seed: int) -> Column:
    """Repeatable scramble of an integer key's low 32 bits: multiply by an odd
    constant and add the seed (mod 2^32), then three xorshift steps. Each step
    is a bijection on 32 bits, so distinct keys never tie; only integer
    arithmetic below 2^63 is used, so any SQL engine gets the same value."""
    m = F.lit(MASK32)
    x = (_c(key).bitwiseAND(m) * F.lit(MIX_MULTIPLIER) + F.lit(seed)).bitwiseAND(m)
    x = x.bitwiseXOR(F.shiftleft(x, 13).bitwiseAND(m))
    x = x.bitwiseXOR(F.shiftright(x, 17))
    return x.bitwiseXOR(F.shiftleft(x, 5).bitwiseAND(m))


def mix32_sql(key: str, seed: int) -> str:
    """``mix32`` as SQL text (for the oracle)."""
    x = f"(({key} & {MASK32}) * {MIX_MULTIPLIER} + {seed}) & {MASK32}"
    x = f"xor({x}, (({x}) << 13) & {MASK32})"
    x = f"xor({x}, ({x}) >> 17)"
    return f"xor({x}, (({x}) << 5) & {MASK32})"


def mix64(key, seed: int) -> list[Column]:
    """Scramble of a whole 64-bit key as two order keys. The pair is a
    bijection of the key, so distinct keys never tie."""
    high = F.shiftrightunsigned(_c(key), 32)
    return [mix32(_c(key).bitwiseXOR(mix32(high, seed)), seed), high]


def mix64_sql(key: str, seed: int) -> str:
    """``mix64`` as SQL text (for the oracle; keys of 0 or more)."""
    high = f"(({key}) >> 32)"
    return f"{mix32_sql(f'xor({key}, {mix32_sql(high, seed)})', seed)}, {high}"
