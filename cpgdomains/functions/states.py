"""Expressions on state labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cpgdomains.schema import COLOURS, State


def state_name(column: Column | str) -> Column:
    """Codes and names in any case to the state's name; blank to null; unknown text stays, trimmed."""
    text = F.trim(F.col(column) if isinstance(column, str) else column)
    whole = F.regexp_replace(text, r"\.0+$", "")
    out = F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
    for s in State:
        out = out.when((whole == str(s.value)) | (F.upper(text) == s.name), s.name)
    return out.otherwise(text)


def state_code(column: Column | str) -> Column:
    """The state's code, null for anything else."""
    name = state_name(column)
    out = F.lit(None).cast("int")
    for s in State:
        out = F.when(name == s.name, int(s)).otherwise(out)
    return out


def state_colour(column: Column | str, colours: dict[str, str] | None = None) -> Column:
    """Display colour of a state; ``colours`` overrides defaults by state name."""
    table = COLOURS | {k.upper(): v for k, v in (colours or {}).items()}
    name, out = state_name(column), F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def stable_round(column: Column | str, digits: int = 6) -> Column:
    """Rounds so that last-bit differences of two engines don't meet a rounding midpoint."""
    return F.round((F.col(column) if isinstance(column, str) else column) + F.lit(1.7e-7), digits)
