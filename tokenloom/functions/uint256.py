"""Exact unsigned 256-bit integers as columns.

A number is a struct of four 64-bit limbs, each a decimal(20,0), the highest
first, so structs compare, sort and group as numbers. Sums add up each limb and
carry once at the end; no double is involved until one is asked for. A result
that needs more than 256 bits, or less than zero, is NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col

LIMBS = ("l3", "l2", "l1", "l0")
BASE = 2**64
CHUNK = 10**9  # of the decimal text; a chunk times 2**32 and a carry fit a bigint


def _dec(value: int | Column, precision: int = 38) -> Column:
    return (F.lit(str(value)) if isinstance(value, int) else value).cast(f"decimal({precision},0)")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _over(c: Column) -> Column:
    """Whole part of a wide limb sum over BASE."""
    return F.call_function("div", c, _dec(BASE)).cast("decimal(38,0)")


def _carried(wide: Column, finish: Callable[[Column, Column], Column]) -> Column:
    """``finish`` of the limbs and the last carry, from a struct of four non-negative limb sums."""

    def step(names: list[str], carry: Column, limbs: dict[str, Column]) -> Column:
        if not names:
            return finish(F.struct(*[limbs[n].alias(n) for n in LIMBS]), carry)
        whole = (_dec(wide[names[-1]]) + carry).cast("decimal(38,0)")
        return _let(whole, lambda w: step(names[:-1], _over(w), {**limbs, names[-1]: (w - _over(w) * _dec(BASE)).cast("decimal(20,0)")}))

    return step(list(LIMBS), _dec(0), {})


def _normal(high_to_low: list[Column]) -> Column:
    """Struct of limbs from four non-negative limb sums; NULL beyond 256 bits."""
    sums = F.struct(*[_dec(c).alias(n) for n, c in zip(LIMBS, high_to_low)])
    return _let(sums, lambda wide: _carried(wide, lambda limbs, carry: F.when(carry == 0, limbs)))


def from_hex(text: Column | str) -> Column:
    """Hex text of up to 64 digits (0x allowed); NULL for anything else."""
    body = F.regexp_replace(F.lower(col(text)), "^0x", "")
    wide = F.lpad(body, 64, "0")
    limbs = [F.conv(F.substring(wide, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)").alias(n) for i, n in enumerate(LIMBS)]
    return F.when(body.rlike("^[0-9a-f]{1,64}$"), F.struct(*limbs))


def from_number(value: Column | str) -> Column:
    """Whole number of up to 38 digits; NULL below zero."""
    v = _dec(col(value))
    low = (v % _dec(BASE, 20)).cast("decimal(20,0)")
    high = ((v - low) / _dec(BASE, 20)).cast("decimal(20,0)")  # divides without rest
    zero = _dec(0, 20)
    return F.when(v >= 0, F.struct(zero.alias("l3"), zero.alias("l2"), high.alias("l1"), low.alias("l0")))


def total(number: Column | str) -> Column:
    """Exact sum, an aggregate; up to 10**18 rows."""
    c = col(number)
    return _normal([F.sum(c[n].cast("decimal(28,0)")) for n in LIMBS])


def add(a: Column | str, b: Column | str) -> Column:
    return _normal([col(a)[n].cast("decimal(38,0)") + col(b)[n].cast("decimal(38,0)") for n in LIMBS])


def subtract(a: Column | str, b: Column | str) -> Column:
    """a - b; NULL if b is greater."""
    a, b = col(a), col(b)
    # two's complement: a + (BASE - 1 - b) per limb + 1, and a carry out where a is not below b
    limbs = [a[n].cast("decimal(38,0)") + (_dec(BASE - 1) - b[n]) + _dec(int(n == "l0")) for n in LIMBS]
    sums = F.struct(*[_dec(c).alias(n) for n, c in zip(LIMBS, limbs)])
    return _let(sums, lambda wide: _carried(wide, lambda out, carry: F.when(carry == 1, out)))


def to_double(number: Column | str) -> Column:
    out = F.lit(0.0)
    for n in LIMBS:
        out = out * F.lit(float(BASE)) + col(number)[n].cast("double")
    return out


def to_decimal(number: Column | str) -> Column:
    """decimal(38,0) where the number has at most 38 digits, else NULL."""
    c = col(number)
    top, rest = divmod(10**38, BASE)
    fits = (c["l3"] == 0) & (c["l2"] == 0) & ((c["l1"] < _dec(top, 20)) | ((c["l1"] == _dec(top, 20)) & (c["l0"] < _dec(rest, 20))))
    return F.when(fits, (_dec(c["l1"]) * _dec(BASE, 20)).cast("decimal(38,0)") + c["l0"]).cast("decimal(38,0)")


def to_text(number: Column | str) -> Column:
    """All decimal digits, up to 78."""
    c = col(number)
    short = to_decimal(c)
    return F.when(short.isNotNull(), short.cast("string")).otherwise(_let(c, _digits))


def _digits(c: Column) -> Column:
    """Long division in bigints: eight 32-bit digits into nine chunks of nine decimal digits, the low one first."""

    def chunk_step(acc: Column, chunk: Column) -> Column:
        whole = acc["carry"] + chunk * F.lit(2**32)  # below 2**63
        return F.struct(F.call_function("div", whole, F.lit(CHUNK)).alias("carry"), F.array_append(acc["out"], whole % F.lit(CHUNK)).alias("out"))

    def digit_step(chunks: Column, digit: Column) -> Column:
        start = F.struct(digit.alias("carry"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(chunks, start, chunk_step, lambda acc: acc["out"])

    half = _dec(2**32, 20)
    digits = F.array(*[d.cast("bigint") for n in LIMBS for d in ((c[n] - c[n] % half) / half, c[n] % half)])
    chunks = F.aggregate(digits, F.array(*[F.lit(0).cast("bigint")] * 9), digit_step)
    text = F.array_join(F.transform(F.reverse(chunks), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.when(c.isNotNull(), F.regexp_replace(text, "^0+(?=.)", ""))


def signed_text(number: Column | str) -> Column:
    """Decimal digits of a two's complement word, with its sign."""
    return _let(col(number), _signed_digits)


def _signed_digits(c: Column) -> Column:
    negative = c["l3"] >= _dec(2**63, 20)
    flipped = F.struct(*[(_dec(BASE - 1, 20) - c[n]).cast("decimal(20,0)").alias(n) for n in LIMBS])
    one = F.struct(*[_dec(int(n == "l0"), 20).alias(n) for n in LIMBS])
    return F.when(negative, F.concat(F.lit("-"), to_text(add(flipped, one)))).otherwise(to_text(c))
