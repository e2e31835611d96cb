"""Scalar column helpers. All are plain Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = "0x00000000"
Q96_SQUARED = 2.0**192


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: Column | str) -> Column:
    return col(c).cast("double")


def scale(raw: Column | str, decimals: Column | int | None = 18) -> Column:
    """Raw integer amount to units; a missing token precision means 18."""
    d = decimals if isinstance(decimals, Column) else F.lit(decimals)
    return dbl(raw) / F.pow(F.lit(10.0), F.coalesce(d, F.lit(18)).cast("double"))


def safe_div(num: Column | str, den: Column | str) -> Column:
    """Ratio as double, NULL where the denominator is zero."""
    return dbl(num) / F.nullif(dbl(den), F.lit(0.0))


def norm_address(c: Column | str) -> Column:
    """Lower-case 0x form; repairs the back-slash prefix of byte literals."""
    text = F.lower(F.trim(col(c)))
    return F.when(text.startswith("\\x"), F.concat(F.lit("0"), text.substr(F.lit(2), F.length(text)))).otherwise(text)


def split_list(text: Column | str, sep: str = ",") -> Column:
    """One row per entry of a delimited list parameter."""
    return F.explode(F.transform(F.split(col(text), sep), lambda x: F.lower(F.trim(x))))


def bucket(ts: Column | str, seconds: int) -> Column:
    """Start of the n-second bucket that holds ``ts``."""
    epoch = F.unix_timestamp(col(ts))
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(seconds)))


def month_label(ts: Column | str) -> Column:
    return F.date_format(col(ts), "MMM yyyy")


def to_int(c: Column | str) -> Column:
    """Rounding cast, the way a numeric-to-integer cast rounds in the source dialect."""
    return F.round(dbl(c), 0).cast("bigint")


def band(value: Column | str, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First label whose lower edge is reached; ``steps`` go from high to low."""
    out: Column | None = None
    for edge, label in steps:
        hit = col(value) >= F.lit(edge)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def category_of(title: Column | str, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """First rule whose text occurs in the title gives the category."""
    out: Column | None = None
    for needle, label in rules:
        hit = col(title).contains(needle)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def pad_zeros(text: Column | str, width: int) -> Column:
    """Zeros in front up to the width; longer texts are kept whole."""
    text = col(text)
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def sort_key(block: Column | str, index: Column | str) -> Column:
    """Text key that sorts by (block, index), both non-negative; 19 digits hold any bigint."""
    return F.concat(pad_zeros(col(block).cast("string"), 19), pad_zeros(col(index).cast("string"), 19))


def tick_price(tick: Column | str, d0: int = 0, d1: int = 0) -> Column:
    return F.pow(F.lit(1.0001), dbl(tick)) * F.lit(10.0 ** (d0 - d1))


def sqrt_price(sqrt_x96: Column | str, d0: int = 0, d1: int = 0) -> Column:
    return dbl(sqrt_x96) * dbl(sqrt_x96) / F.lit(Q96_SQUARED) * F.lit(10.0 ** (d0 - d1))


def hex_word(data: Column | str, word: int, width: int = 64) -> Column:
    """The n-th fixed-width hex word of a log payload (0x prefix allowed)."""
    body = F.regexp_replace(F.lower(col(data)), "^0x", "")
    return F.substring(body, word * width + 1, width)


def hex_to_number(text: Column | str) -> Column:
    """Hex text to double, folded in 8-digit chunks so that no chunk overflows; NULL beyond 64 digits."""
    padded = F.when(F.length(col(text)) <= 64, F.lpad(col(text), 64, "0"))
    total = F.lit(0.0)
    for i in range(8):
        chunk = F.conv(F.substring(padded, i * 8 + 1, 8), 16, 10).cast("double")
        total = total * F.lit(4294967296.0) + chunk
    return total
