"""Fitted column transforms: log2 offsets, medians, standard scaling.

Each fit is one or a few map-side-combined aggregations over all columns at once and
returns one number per column; each apply is a single projection.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numbers import present_sql, quoted

# A median is finished by an exact sort once at most this many candidate values are left: at most
# two lists of them per column meet in the final task, 320 kB a column.
MEDIAN_VALUES_IN_MEMORY = 20_000


def _one_row(df: DataFrame, aggregates: Mapping[Hashable, str]) -> dict:
    """Values of several SQL aggregates over one scan."""
    keys = list(aggregates)
    row = df.agg(*[F.expr(aggregates[k]).alias(f"a{i}") for i, k in enumerate(keys)]).first()
    return dict(zip(keys, row))


def _replace(df: DataFrame, new: Mapping[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{new[c]} AS {quoted(c)}" if c in new else quoted(c) for c in df.columns])


def _literal(value: float) -> str:
    return f"double('{float(value)!r}')"


# --- log2 -------------------------------------------------------------------


def fit_log2(df: DataFrame, columns: Sequence[str], exclude: Sequence[str] = ()) -> dict[str, float]:
    """Offset per column: 0 when all values are positive, else ``|min| + 1``."""
    return offsets_of(fit_lowest(df, [c for c in columns if c not in exclude]))


def fit_lowest(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return _one_row(df, {c: f"min({present_sql(c)})" for c in columns}) if columns else {}


def offsets_of(lowest: Mapping[str, float | None]) -> dict[str, float]:
    return {c: 0.0 if m is None or m > 0 else abs(m) + 1.0 for c, m in lowest.items()}


def apply_log2(df: DataFrame, offsets: Mapping[str, float], lowest: Mapping[str, float] | None = None) -> DataFrame:
    """Log2 of each shifted column; values below ``lowest`` (where given) count as the lowest."""
    return _replace(df, {c: f"log2({_clamped(c, (lowest or {}).get(c))} + {_literal(o)})" for c, o in offsets.items()})


def _clamped(column: str, low: float | None) -> str:
    value = present_sql(column)
    return value if low is None else f"nvl2({value}, greatest({value}, {_literal(low)}), null)"


def count_below(df: DataFrame, lowest: Mapping[str, float | None], out: str) -> DataFrame:
    """``out``: how many values of each row lie below the lowest fitted value of their column."""
    below = [f"cast(coalesce({present_sql(c)} < {_literal(low)}, false) as int)" for c, low in lowest.items() if low is not None]
    return df.withColumn(out, F.expr(" + ".join(below) or "0"))


def log2_normalize(df: DataFrame, columns: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    return apply_log2(df, fit_log2(df, columns, exclude))


# --- standard scaling -------------------------------------------------------


@dataclass(frozen=True)
class Scaling:
    means: dict[str, float]
    stds: dict[str, float]


def fit_standardize(df: DataFrame, columns: Sequence[str]) -> Scaling:
    """Mean and population standard deviation of complete rows; infinite input is an error.

    All columns are summarised as one vector: a single aggregation buffer, where separate
    aggregates over forty columns would be too wide for generated code.
    """
    names = list(columns)
    vector = VectorAssembler(inputCols=names, outputCol="_v", handleInvalid="error").transform(df)
    summary = vector.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).first()["s"]
    n = summary["count"]
    if n == 0:
        return Scaling(dict.fromkeys(names), dict.fromkeys(names))
    means = [float(m) for m in summary["mean"]]
    bad = [c for c, m in zip(names, means) if not math.isfinite(m)]
    if bad:
        raise ValueError(f"infinite values in {bad}")
    stds = [math.sqrt(max(float(v), 0.0) * (n - 1) / n) for v in summary["variance"]]
    return Scaling(dict(zip(names, means)), dict(zip(names, stds)))


def apply_standardize(df: DataFrame, scaling: Scaling) -> DataFrame:
    """``(x - mean) / std``; a constant column becomes 0."""
    scaled = {
        c: f"({present_sql(c)} - {_literal(m)}) / {_literal(scaling.stds[c] or 1.0)}"
        for c, m in scaling.means.items()
        if m is not None
    }
    return _replace(df, scaled)


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return apply_standardize(df, fit_standardize(df, columns))


# --- medians ----------------------------------------------------------------


@dataclass
class _Search:
    """Open value interval of a column that is known to hold the value of some rank."""

    column: str
    rank: int
    below: int
    inside: int
    low: float | None = None
    high: float | None = None

    @property
    def interval(self) -> tuple:
        return self.column, self.low, self.high

    def candidates(self) -> str:
        value = present_sql(self.column)
        limits = [f"{value} > {_literal(self.low)}"] if self.low is not None else []
        limits += [f"{value} < {_literal(self.high)}"] if self.high is not None else []
        return f"if({' and '.join(limits)}, {value}, null)" if limits else value


def fit_medians(
    df: DataFrame, columns: Sequence[str], in_memory: int = MEDIAN_VALUES_IN_MEMORY
) -> dict[str, float | None]:
    """Exact interpolating median of every column, missing values ignored.

    An exact percentile keeps all distinct values of a column in one task. Here each
    middle rank keeps an open value interval that is known, by counting, to hold it; every
    pass narrows it with approximate quantiles of what is inside, and once few values are
    left they are sorted exactly. Passes scan but never shuffle rows, and their number
    grows with the logarithm of the row count.
    """
    counts = _one_row(df, {c: f"count({present_sql(c)})" for c in columns})
    searches = [
        _Search(c, rank, below=0, inside=n)
        for c, n in counts.items()
        if n
        for rank in sorted({(n - 1) // 2, n // 2})
    ]
    found: dict[str, list[float]] = {c: [] for c in columns}
    while searches:
        _pick([s for s in searches if s.inside <= in_memory], df, found)
        searches = _narrow([s for s in searches if s.inside > in_memory], df, found)
    return {c: sum(v) / len(v) if v else None for c, v in found.items()}


def _pick(searches: list[_Search], df: DataFrame, found: dict[str, list[float]]) -> None:
    """Read the wanted ranks from the few sorted values of each interval."""
    if not searches:
        return
    positions: dict[tuple, list[_Search]] = {}
    for s in searches:
        positions.setdefault(s.interval, []).append(s)
    picked = _one_row(
        df,
        {
            key: f"transform(array({', '.join(str(s.rank - s.below) for s in group)}), "
            f"i -> get(sort_array(collect_list({group[0].candidates()})), i))"
            for key, group in positions.items()
        },
    )
    for key, values in picked.items():
        found[key[0]].extend(values)


def _narrow(searches: list[_Search], df: DataFrame, found: dict[str, list[float]]) -> list[_Search]:
    """Tighten every interval; a rank that falls on a cut value itself is finished.

    Cut values come from inside the open interval and are left out of the next one, so
    every pass makes progress whatever the values are.
    """
    if not searches:
        return []
    cuts = _one_row(df, {s.interval: _cuts(s) for s in searches})
    edges = {(s.column, e) for s in searches for e in cuts[s.interval]}
    seen = _one_row(
        df,
        {
            (c, e): f"struct(count_if({present_sql(c)} < {_literal(e)}) AS lt, count_if({present_sql(c)} <= {_literal(e)}) AS le)"
            for c, e in edges
        },
    )
    still_open = []
    for s in searches:
        total = s.below + s.inside
        on_edge = False
        for edge in sorted(set(cuts[s.interval])):
            at = seen[s.column, edge]
            if at["le"] <= s.rank:
                s.low, s.below = edge, at["le"]
            elif at["lt"] <= s.rank:
                found[s.column].append(edge)
                on_edge = True
                break
            else:
                s.high, total = edge, at["lt"]
                break
        if not on_edge:
            s.inside = total - s.below
            still_open.append(s)
    return still_open


def _cuts(search: _Search) -> str:
    """Values a little below and above the wanted rank, inside the interval."""
    target = (search.rank - search.below + 0.5) / search.inside
    probs = f"array({max(target - 0.0005, 0.0)!r}D, {min(target + 0.0005, 1.0)!r}D)"
    return f"percentile_approx({search.candidates()}, {probs}, 10000)"


def fill_missing(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    filled = {c: f"coalesce({present_sql(c)}, {_literal(v)})" for c, v in values.items() if v is not None}
    return _replace(df, filled)


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill_missing(df, fit_medians(df, columns))


def median_of_cells(df: DataFrame, columns: Sequence[str]) -> float | None:
    """Median over every value of every listed column together."""
    cells = df.selectExpr(f"explode(array({', '.join(present_sql(c) for c in columns)})) AS cell")
    return fit_medians(cells, ["cell"])["cell"]
