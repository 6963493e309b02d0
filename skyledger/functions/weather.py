"""Weather columns: coded phenomena, ceilings, flight categories and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cover codes that make a ceiling, codes of frozen precipitation or freezing fog, and the
#: height that stands for no ceiling.
CEILING_COVERS = ("BKN", "OVC", "VV")
FROZEN_CODES = ("SN", "FZRA", "FZDZ", "PL", "PE", "GS", "IC", "FZFG", "BLSN")
UNLIMITED = 99999.0
#: Categories from best to worst.
CATEGORIES = ("VFR", "MVFR", "IFR", "LIFR")


def number(text: Column) -> Column:
    """A number, or null where the text is none."""
    return text.try_cast("double")


def has_thunderstorm(codes: Column) -> Column:
    return F.coalesce(F.upper(codes).contains("TS"), F.lit(False))


def has_frozen(codes: Column) -> Column:
    """True if a group contains a frozen code anywhere; codes have no spaces, so groups need no splitting."""
    return F.coalesce(F.upper(codes).rlike("|".join(FROZEN_CODES)), F.lit(False))


def ceiling(covers: list[Column], heights: list[Column]) -> Column:
    """Lowest broken, overcast or obscured layer; ``UNLIMITED`` if the sky was reported without one, else null."""
    cover = [F.upper(F.trim(c)) for c in covers]
    lowest = F.least(*[F.when(c.isin(*CEILING_COVERS), h) for c, h in zip(cover, heights)]) if len(covers) > 1 else F.when(cover[0].isin(*CEILING_COVERS), heights[0])
    return F.coalesce(lowest, F.when(F.coalesce(*cover).isNotNull(), F.lit(UNLIMITED)))


def flight_category(ceiling_ft: Column, visibility_sm: Column) -> Column:
    """The worse category of ceiling and visibility; null unless both are known."""
    worst = F.when((ceiling_ft < 500) | (visibility_sm < 1), "LIFR").when((ceiling_ft < 1000) | (visibility_sm < 3), "IFR")
    worst = worst.when((ceiling_ft <= 3000) | (visibility_sm <= 5), "MVFR").otherwise("VFR")
    return F.when(ceiling_ft.isNotNull() & visibility_sm.isNotNull(), worst)


def category_rank(category: Column) -> Column:
    """0 for the best category; null for an unknown one."""
    return F.when(category.isin(*CATEGORIES), F.array_position(F.array(*map(F.lit, CATEGORIES)), category) - 1)


def celsius(fahrenheit: Column) -> Column:
    return (fahrenheit - 32) * 5 / 9


def millimetres(inches: Column) -> Column:
    return inches * 25.4


def precipitation(text: Column) -> Column:
    """Millimetres of a text in inches; T, a trace, is 0."""
    return F.when(F.upper(F.trim(text)) == "T", F.lit(0.0)).otherwise(millimetres(number(text)))
