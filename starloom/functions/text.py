"""Small text functions of records and metadata, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Micrometres in each length unit.
UM_PER_UNIT = {"m": 1e6, "cm": 1e4, "mm": 1e3, "um": 1.0, "nm": 1e-3, "pm": 1e-6, "inch": 25400.0, "micron": 1.0}
#: Names by which matchers may be called.
MATCHERS_2D = {"triangle": "triangles", "tri": "triangles", "tris": "triangles"}
MATCHERS_3D = {"hashing3d": "hashing", "hash": "hashing", "pyramid3d": "pyramid", "tetra": "pyramid", "tetrahedron": "pyramid"}
TRUE_WORDS = ("true", "1", "yes", "y")


def lookup(x: Column, table: Mapping[str, object]) -> Column:
    """The table's value for a key, null for others."""
    return F.try_element_at(F.create_map(*[F.lit(v) for item in table.items() for v in item]), x)


def matcher_name(x: Column, aliases: Mapping[str, str] = MATCHERS_2D) -> Column:
    name = F.lower(F.trim(x))
    return F.coalesce(lookup(name, aliases), name)


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin(*TRUE_WORDS), F.lit(False))


def number(x: Column) -> Column:
    """A finite number, or null for any other text."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def ratio(x: Column) -> Column:
    """A number, or "a/b"; null for a zero denominator."""
    parts = F.split(F.trim(x), "/")
    quotient = F.try_divide(number(F.trim(F.get(parts, F.lit(0)))), number(F.trim(F.get(parts, F.lit(1)))))
    return F.when(F.size(parts) == 1, number(F.trim(x))).when(F.size(parts) == 2, quotient)


def unit_name(x: Column) -> Column:
    """Lower-case unit; Greek and micro signs become u, and long names short."""
    short = F.replace(F.translate(F.lower(F.trim(x)), "µμ", "uu"), F.lit(" "), F.lit(""))
    return F.coalesce(lookup(short, {"micrometer": "um", "micrometre": "um", "microns": "um", "nanometer": "nm", "millimeter": "mm", "in": "inch", "inches": "inch"}), short)


def to_um(value: Column, unit: Column) -> Column:
    return value * lookup(unit_name(unit), UM_PER_UNIT)


def key_values(x: Column) -> Column:
    """``key=value`` lines as a map; keys are to be distinct."""
    lines = F.filter(F.split(x, "\r?\n"), lambda line: line.contains("="))
    pairs = F.transform(lines, lambda line: F.struct(F.trim(F.substring_index(line, "=", 1)).alias("key"), F.trim(F.regexp_replace(line, "^[^=]*=", "")).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["key"] != ""))


def scalar_text(x: Column) -> Column:
    """What a setting's text stands for, as JSON text: null words, whole numbers (also 100_000), decimals, else a string."""
    t = F.trim(x)
    plain = F.replace(t, F.lit("_"), F.lit(""))
    whole = F.when(plain.rlike("^[+-]?[0-9]+$"), plain.try_cast("bigint").cast("string"))
    decimal = F.when(plain.rlike("^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$"), plain.try_cast("double").cast("string"))
    return F.when(F.lower(t).isin("none", "null", ""), F.lit("null")).otherwise(F.coalesce(whole, decimal, F.concat(F.lit('"'), t, F.lit('"'))))


def adler32(x: Column) -> Column:
    """Adler-32 of the UTF-8 bytes: the stable seed of a job's name."""
    codes = F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(x) - 1, F.lit(0))), lambda k: F.conv(F.substring(F.hex(F.encode(x, "UTF-8")), (k * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    step = lambda s, c: F.struct(((s["a"] + c) % 65521).alias("a"), ((s["b"] + s["a"] + c) % 65521).alias("b"))
    return F.when(F.octet_length(x) == 0, F.lit(1).cast("long")).otherwise(F.aggregate(codes, start, step, lambda s: s["b"] * 65536 + s["a"]))
