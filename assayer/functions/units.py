"""Units of measure: aliases, conversion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unit, dimension, factor to the dimension's base unit, offset after scaling, and how people write it.
UNITS = [
    ("mg/dL", "mass density", 0.01, 0.0, ["milligrams per deciliter", "mg per dl", "mg/dl", "milligrams/deciliter"]), ("g/dL", "mass density", 10.0, 0.0, ["grams per deciliter", "g/dl"]),
    ("ug/dL", "mass density", 1e-5, 0.0, ["micrograms per deciliter", "ug/dl", "mcg/dl"]), ("ng/mL", "mass density", 1e-6, 0.0, ["nanograms per milliliter", "ng/ml"]),
    ("mmol/L", "amount density", 1.0, 0.0, ["millimoles per liter", "mmol per l", "mmol/l"]), ("mEq/L", "equivalents", 1.0, 0.0, ["milliequivalents per liter", "meq/l", "meq per l"]),
    ("IU/L", "activity", 1.0, 0.0, ["international units per liter", "iu/l"]), ("U/L", "activity", 1.0, 0.0, ["units per liter", "u/l"]),
    ("kg", "mass", 1000.0, 0.0, ["kilograms", "kilogram"]), ("g", "mass", 1.0, 0.0, ["grams", "gram"]), ("mg", "mass", 0.001, 0.0, ["milligrams", "milligram"]), ("ug", "mass", 1e-6, 0.0, ["micrograms", "microgram", "mcg"]),
    ("lb", "mass", 453.59237, 0.0, ["pounds", "pound", "lbs"]), ("oz", "mass", 28.349523125, 0.0, ["ounces", "ounce"]),
    ("m", "length", 1.0, 0.0, ["meters", "meter"]), ("cm", "length", 0.01, 0.0, ["centimeters", "centimeter"]), ("inch", "length", 0.0254, 0.0, ["inches", "in"]), ("ft", "length", 0.3048, 0.0, ["feet", "foot"]),
    ("L", "volume", 1.0, 0.0, ["liters", "liter", "litres", "litre"]), ("dL", "volume", 0.1, 0.0, ["deciliters", "deciliter", "dl"]), ("mL", "volume", 0.001, 0.0, ["milliliters", "milliliter", "ml"]),
    ("degC", "temperature", 1.0, 273.15, ["degrees celsius", "celsius", "degc"]), ("degF", "temperature", 5 / 9, 459.67 * 5 / 9, ["degrees fahrenheit", "fahrenheit", "degf"]),
    ("mmHg", "pressure", 133.322387415, 0.0, ["millimeters of mercury", "mmhg", "mm hg"]), ("s", "time", 1.0, 0.0, ["seconds", "second", "sec"]), ("min", "time", 60.0, 0.0, ["minutes", "minute"]), ("hr", "time", 3600.0, 0.0, ["hours", "hour", "hr", "hrs"]),
    ("%", "share", 0.01, 0.0, ["percent", "pct"]), ("count/min", "rate", 1.0, 0.0, ["beats per minute", "bpm", "breaths per minute"]),
]
#: Unit spellings in running text and their canonical form, in order.
SPELLINGS = [
    (r"(?i)\bmg/dL\b", "mg/dL"), (r"(?i)\bmmol/L\b", "mmol/L"), (r"\bm[Ee]q/L\b", "mEq/L"), (r"(?i)\bng/mL\b", "ng/mL"), (r"(?i)\bpg/mL\b", "pg/mL"), (r"(?i)\bug/dL\b", "ug/dL"), (r"(?i)\bmcg\b", "mcg"), (r"(?i)\bIU/L\b", "IU/L"),
    (r"\bu/l\b", "U/L"), (r"\b10\*3/uL\b", "10^3/uL"), (r"\b10\*6/uL\b", "10^6/uL"), (r"(?i)\bx10E3/uL\b", "10^3/uL"), (r"(?i)\bx10E6/uL\b", "10^6/uL"), (r"(?i)\bmmHg\b", "mmHg"), (r"(?i)\bbpm\b", "bpm"),
    (r"(?i)\bcelsius\b", "Cel"), (r"\bdeg\s*[Cc]\b", "Cel"), (r"\b[Dd]egrees?\s+[Ff]ahrenheit\b", "degF"), (r"\bdeg\s*[Ff]\b", "degF"), (r"(?i)\bbeats?\s*/\s*min(?:ute)?\b", "bpm"), (r"(?i)\bbreaths?\s*/\s*min(?:ute)?\b", "breaths/min"),
]


def spell(text: Column) -> Column:
    """Unit spellings in running text in their canonical form."""
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), SPELLINGS, text)


def unit_table(spark: SparkSession) -> DataFrame:
    """(alias, unit, dimension, factor, shift): a row for each lower-case spelling of each unit."""
    rows = [(alias, u, d, f, o) for u, d, f, o, aliases in UNITS for alias in sorted({*aliases, u.lower()})]
    return spark.createDataFrame(rows, "alias string, unit string, dimension string, factor double, shift double")


def convert(df: DataFrame, value: str, unit: str, to: str, out: str = "converted") -> DataFrame:
    """Append ``out``: the value in another unit; null if either unit is unknown or they measure different things."""
    spark = df.sparkSession
    side = lambda p: unit_table(spark).select(*(F.col(c).alias(f"__{p}_{c}") for c in ("alias", "unit", "dimension", "factor", "shift")))
    known = lambda c: F.lower(F.trim(F.col(c)))
    joined = df.join(F.broadcast(side("a")), known(unit) == F.col("__a_alias"), "left").join(F.broadcast(side("b")), known(to) == F.col("__b_alias"), "left")
    base = F.col(value) * F.col("__a_factor") + F.col("__a_shift")
    return joined.withColumn(out, F.when(F.col("__a_dimension") == F.col("__b_dimension"), (base - F.col("__b_shift")) / F.col("__b_factor"))).select(*df.columns, out)
