"""Sizes, tiers and bands as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits per weight by quantisation, and the bits where the name is unknown.
QUANT_BITS = {
    "Q2_K": 3.0, "Q3_K_S": 3.4, "Q3_K_M": 3.8, "Q3_K_L": 4.0, "Q4_0": 4.5, "Q4_1": 5.0, "Q4_K_S": 4.3, "Q4_K_M": 4.5, "Q5_0": 5.5, "Q5_1": 6.0,
    "Q5_K_S": 5.4, "Q5_K_M": 5.5, "Q6_K": 6.6, "Q8_0": 8.5, "F16": 16.0, "FP16": 16.0, "BF16": 16.0, "F32": 32.0, "FP32": 32.0,
}
OTHER_BITS = 4.5
#: Context sizes; lower bounds of tiers by whole GB and by free GiB.
CONTEXTS = (4096, 8192, 16384, 32768, 65536, 131072)
TIERS = ((64, "extreme"), (26, "professional"), (13, "ample"), (7, "comfortable"))
HEADROOM = ((60, "extreme"), (24, "professional"), (11, "ample"), (5, "comfortable"), (2, "min"))


def params_b(c: Column) -> Column:
    """'7b', '70m', '1.5b' as billions of parameters."""
    s = F.lower(F.regexp_replace(F.trim(c), ",", ""))
    number = F.regexp_extract(s, r"^([0-9.]+)\s*([bm])?$", 1)
    n = F.when(number != "", number.try_cast("double"))
    return F.when(F.regexp_extract(s, r"^([0-9.]+)\s*([bm])?$", 2) == "m", n / 1000.0).otherwise(n)


def vram_gb(size: Column, quant: Column, context_k: Column) -> Column:
    p = params_b(size)
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in QUANT_BITS.items()))
    bits = F.coalesce(F.element_at(table, F.upper(F.regexp_replace(quant, " ", ""))), F.lit(OTHER_BITS))
    return p * bits / 8.0 + p * 0.05 * F.greatest(F.lit(1.0), context_k / 4.0) + 0.5


def fit(need: Column, have: Column) -> Column:
    share = need / have
    return F.when(need.isNull() | have.isNull(), "unknown").when(share <= 0.85, "fits").when(share <= 1.05, "tight").otherwise("over")


def _steps(c: Column, steps, last: str) -> Column:
    out = None
    for bound, name in steps:
        out = F.when(c >= bound, name) if out is None else out.when(c >= bound, name)
    return out.otherwise(last)


def tier(gb: Column) -> Column:
    return _steps(gb, TIERS, "min")


def headroom_tier(mb: Column) -> Column:
    return _steps(mb, tuple((g * 1024, n) for g, n in HEADROOM), "insufficient")


def speed_band(bandwidth: Column, vram_mb: Column) -> tuple[Column, Column]:
    """Low and high tokens per second."""
    mid = F.greatest(F.lit(5), F.floor(bandwidth / F.greatest(F.lit(0.5), vram_mb / 1024.0) * 0.6).cast("int"))
    return F.greatest(F.lit(2), F.floor(mid * 0.7).cast("int")), F.floor(mid * 1.3).cast("int")


def required_gb(total_mb: Column) -> tuple[Column, Column]:
    least = F.ceil(total_mb / 1024.0)
    return least, F.greatest(least + 1, F.ceil(total_mb * 1.25 / 1024.0))


def context_size(chars: Column, max_tokens: Column, most: Column) -> Column:
    """The smallest context that holds prompt and answer, or the largest allowed."""
    need = F.floor(chars / 3.5).cast("long") + 64 + max_tokens + 256
    fits = F.filter(F.array(*map(F.lit, CONTEXTS)), lambda b: (b >= need) & (b <= most))
    return F.coalesce(F.array_min(fits).cast("long"), most.cast("long"))


def readable_bytes(n: Column) -> Column:
    n = n.cast("double")
    out = F.when(n < 1024, F.format_string("%.0f B", n)).when(n < 1024.0**2, F.format_string("%.0f KB", n / 1024.0))
    return out.when(n < 1024.0**3, F.format_string("%.1f MB", n / 1024.0**2)).when(n < 1024.0**4, F.format_string("%.1f GB", n / 1024.0**3)).otherwise(F.format_string("%.1f TB", n / 1024.0**4))


MISSING = "—"


def whole(v: Column, unit: str) -> Column:
    """A measure rounded to a whole number (halves to even) with its unit, a dash where it is missing."""
    return F.when(v.isNull(), MISSING).otherwise(F.concat(F.bround(v, 0).cast("long").cast("string"), F.lit(unit)))


def gigabytes(v: Column) -> Column:
    return F.when(v.isNull(), MISSING).otherwise(F.format_string("%.1f GB", F.bround(v, 1)))


def about_vram(gb: Column) -> Column:
    """An estimate of memory: megabytes under one gigabyte, nothing where it is missing."""
    return F.when(gb.isNull(), "").when(gb < 1, F.format_string("~%.0f MB", F.bround(gb * 1024, 0))).otherwise(F.format_string("~%.1f GB", F.bround(gb, 1)))
