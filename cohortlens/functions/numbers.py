"""Number rules shared by every operator: one meaning of "missing", safe ratios.

Per-column rules over wide tables are SQL text: one expression per column is parsed in the
JVM, where building it from Python calls would cost more than the small jobs themselves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: texts that count as a number once every `*` is gone.
NUMBER_PATTERN = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i)inf(inity)?)\s*$"


def quoted(name: str) -> str:
    """Column name made safe for names such as ``CA 15-3 (U/ml)``."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def number_in_text_sql(name: str) -> str:
    """Number behind a marked text column; NULL when it is not a number.

    The pattern refuses what the JVM alone would accept (``1.5d``, ``NaN``), and a finite
    text that overflows to infinity is missing too.
    """
    bare = f"replace({quoted(name)}, '*', '')"
    value = f"if({bare} rlike r'{NUMBER_PATTERN}', try_cast({bare} as double), null)"
    overflow = f"abs({value}) = double('infinity') and not contains(lower({bare}), 'inf')"
    return f"if({overflow}, null, {value})"


def present_sql(name: str) -> str:
    """Column as double with NaN turned into NULL.

    Spark ranks NaN above every number in min, max and median, so only NULL may mean missing.
    """
    return f"nanvl(cast({quoted(name)} as double), cast(null as double))"


def present(name: str) -> Column:
    return F.expr(present_sql(name))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` in double, NULL for an empty whole (ANSI mode would raise)."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))
