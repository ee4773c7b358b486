"""Numbers written with a decimal comma and dots between thousands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[0-9][0-9.]*(?:,[0-9]+)?"


def number(text: Column, kind: str = "decimal(10,2)") -> Column:
    """The first number of a text, or null: 1.000 is a thousand, 1,5 is one and a half."""
    found = F.nullif(F.regexp_extract(text, f"({NUMBER})", 1), F.lit(""))
    return F.replace(F.replace(found, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast(kind)


def span(text: Column, kind: str = "decimal(10,2)") -> Column:
    """(lo, hi, approx) of a range such as 60-70% or R$ 1,5–2,4; one number is both ends; a tilde marks an approximate one."""
    found = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))
    lo = number(F.get(found, F.lit(0)), kind)
    return F.struct(lo.alias("lo"), F.coalesce(number(F.get(found, F.lit(1)), kind), lo).alias("hi"), F.coalesce(text.contains("~"), F.lit(False)).alias("approx"))
