"""Display text: names and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_name(name: Column, drop_prefix: str = "") -> Column:
    """``risk_flood_health`` to ``Flood Health``."""
    if drop_prefix:
        name = F.replace(name, F.lit(drop_prefix), F.lit(""))
    return F.initcap(F.translate(name, "_", " "))


def fixed(c: Column, digits: int, suffix: str = "") -> Column:
    """Fixed-point text such as ``27.4 C``; a missing number stays missing."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f{suffix.replace('%', '%%')}", c))
