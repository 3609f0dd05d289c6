"""Column expressions used by several operators."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kernel falls to this value at its radius.
KERNEL_EDGE = 0.001


def sigma(radius: float) -> float:
    return radius / math.sqrt(-2 * math.log(KERNEL_EDGE))


def gaussian(d2: Column, radius: float) -> Column:
    """Kernel weight from a squared distance."""
    return F.exp(-d2 / F.lit(2 * sigma(radius) ** 2))


def modulator_group(name: Column) -> Column:
    """Group of a modulator by its name: '@' before '$' before '#', else a transcription factor."""
    return F.when(name.contains("@"), "metab").when(name.contains("$"), "lr").when(name.contains("#"), "ltf").otherwise("tf")


def factor_genes(name: Column) -> Column:
    """Genes that a factor's name refers to; none for metabolites."""
    return F.when(name.contains("@"), F.array().cast("array<string>")).otherwise(F.split(name, "[$#]"))


def cell_family(label: Column) -> Column:
    name = F.lower(F.trim(label))
    rest = name.isin("other", "background", "rest")
    tcell = name.rlike(r"t[ -]cell|cd[48]|\btregs?\b|gamma delta")
    return F.when(~rest & tcell, "tcell").otherwise("other")


def contains_ci(c: Column, query: str) -> Column:
    return F.contains(F.lower(c), F.lit(query.lower()))


# Chebyshev coefficients of erfc, lowest order first.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal, by the complementary error function's rational approximation (error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    p = F.lit(ERFC[-1])
    for k in reversed(ERFC[:-1]):
        p = p * t + k
    tail = t * F.exp(-x * x + p) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def unordered_pair(a: Column, b: Column) -> Column:
    return F.array_sort(F.array(a, b))


# ---------------------------------------------------------------- texts of numbers


def _plain_exponent(v: float, sign: str = "") -> str:
    mantissa, exponent = format(v, f"{sign}.1e").split("e")
    return f"{mantissa}e{int(exponent)}"


def _strength(v: float) -> str:
    a = abs(v)
    if a == 0:
        return "0"
    if a >= 1:
        return format(v, ".0f" if a >= 100 else ".1f")
    digits = int(format(a, ".1e").split("e")[1])
    return _plain_exponent(v) if digits < -6 else format(v, f".{1 - digits}f")


_TEXTS = {
    "strength": _strength,
    "scientific": lambda v: format(v, ".1e"),
    "exponent": _plain_exponent,
    "rate": lambda v: "0" if v == 0 else _plain_exponent(v) if v < 0.001 else format(v, ".3f"),
    "beta": lambda v: "0" if v == 0 else _plain_exponent(v, "+"),
}


def number_text(c: Column, kind: str, none: str) -> Column:
    """Numbers of a result table as text, rounded from their exact binary value, which the engine's own formats do not."""
    show = _TEXTS[kind]

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return pd.Series([none if v is None or v != v else show(float(v)) for v in values])

    return text(c.cast("double"))


def strength_text(v: Column) -> Column:
    """A strength: no decimals from 100 up, one from 1 up, else two significant digits."""
    return number_text(v, "strength", "—")


def exponent_text(v: Column) -> Column:
    """One decimal and a plain exponent, such as 4.5e-3."""
    return number_text(v, "exponent", "—")


def rate_text(v: Column) -> Column:
    """A rate or p: three decimals, scientific below a thousandth."""
    return number_text(v, "rate", "—")


def beta_text(v: Column, floor: float = 0.0) -> Column:
    """A coefficient: none, 0, about 0 at or under the floor, else signed with an exponent."""
    return F.when(v.isNotNull() & (v != 0) & (F.abs(v) <= floor), "≈0").otherwise(number_text(v, "beta", "—"))


def slug(c: Column) -> Column:
    """Letters and digits, other runs as one underscore, none at the ends."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, "[^0-9A-Za-z]+", " ")), " ", "_")


def chi2_even_sf(x: Column, half: int) -> Column:
    """Upper tail of chi-squared with 2 * ``half`` degrees of freedom, summed in closed form."""
    terms = sum(((F.pow(x / 2, F.lit(i)) / math.factorial(i)) for i in range(1, half)), F.lit(1.0))
    return F.least(F.lit(1.0), F.exp(-x / 2) * terms)
