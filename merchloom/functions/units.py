"""Weights and dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import lookup
from .money import round_half_up

# Grams and centimetres in a unit, and the short name of each alias.
GRAMS = {"g": 1.0, "kg": 1000.0, "lb": 453.59237, "oz": 28.349523125}
CENTIMETRES = {"cm": 1.0, "mm": 0.1, "m": 100.0, "in": 2.54, "ft": 30.48, "yd": 91.44}
WEIGHT_ALIASES = {"g": "g gram grams", "kg": "kg kgs kilogram kilograms", "lb": "lb lbs pound pounds", "oz": "oz ounce ounces"}
LENGTH_ALIASES = {
    "cm": "cm cms centimetre centimetres centimeter centimeters",
    "mm": "mm millimetre millimetres millimeter millimeters",
    "m": "m metre metres meter meters",
    "in": 'in ins inch inches "',
    "ft": "ft foot feet",
    "yd": "yd yard yards",
}
# Unit codes of structured data.
UNIT_CODES = {"GRM": "g", "KGM": "kg", "LBR": "lb", "ONZ": "oz"}


def _names(aliases: dict[str, str]) -> dict[str, str]:
    return {name: short for short, names in aliases.items() for name in names.split()}


def weight_unit(unit: Column) -> Column:
    return lookup(_names(WEIGHT_ALIASES), F.lower(F.trim(unit)))


def dimension_unit(unit: Column) -> Column:
    return lookup(_names(LENGTH_ALIASES), F.lower(F.trim(unit)))


def to_grams(value: Column, unit: Column) -> Column:
    """Grams with three places; no unit means grams, an unknown unit gives null."""
    return round_half_up(value * lookup(GRAMS, weight_unit(F.coalesce(unit, F.lit("g")))), 3)


def to_kilograms(value: Column, unit: Column) -> Column:
    return round_half_up(to_grams(value, unit) / 1000, 6)


def to_centimetres(value: Column, unit: Column) -> Column:
    return round_half_up(value * lookup(CENTIMETRES, dimension_unit(F.coalesce(unit, F.lit("cm")))), 3)


def unit_from_code(code: Column) -> Column:
    return F.coalesce(lookup(UNIT_CODES, F.upper(F.trim(code))), weight_unit(code))


def unit_from_html(text: Column) -> Column:
    return weight_unit(F.nullif(F.regexp_extract(text, r"(?i)\b(kg|g|lbs?|oz)\b", 1), F.lit("")))
