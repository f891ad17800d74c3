"""Air quality index: conversion from and to concentrations, categories, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Breakpoints for PM2.5 in µg/m³ by convention, as
#: (concentration from, to, index from, to).
BREAKPOINTS = {
    2012: (
        (0.0, 12.0, 0, 50),
        (12.1, 35.4, 51, 100),
        (35.5, 55.4, 101, 150),
        (55.5, 150.4, 151, 200),
        (150.5, 250.4, 201, 300),
        (250.5, 350.4, 301, 400),
        (350.5, 500.4, 401, 500),
    ),
    2024: (
        (0.0, 9.0, 0, 50),
        (9.1, 35.4, 51, 100),
        (35.5, 55.4, 101, 150),
        (55.5, 125.4, 151, 200),
        (125.5, 225.4, 201, 300),
        (225.5, 325.4, 301, 500),
    ),
}
#: Highest index of each category.
CATEGORIES = (
    (50, "Good"),
    (100, "Moderate"),
    (150, "Unhealthy for Sensitive Groups"),
    (200, "Unhealthy"),
    (300, "Very Unhealthy"),
    (10000, "Hazardous"),
)
#: Lower edges of the bands after the first.
BAND_EDGES = (50, 100, 150, 200, 300)


def _piecewise(x: Column, rows: list[tuple[float, float, float, float]]) -> Column:
    """Straight lines through (x from, x to, y from, y to), the first whose end isn't passed; the
    last line goes on. Null for null, NaN and negative values."""

    def line(row: tuple[float, float, float, float]) -> Column:
        a, b, c, d = map(float, row)
        return (x - a) * ((d - c) / (b - a)) + c

    out = F.when(x.isNull() | F.isnan(x) | (x < 0), None)
    for row in rows[:-1]:
        out = out.when(x <= float(row[1]), line(row))
    return out.otherwise(line(rows[-1]))


def pm25_to_aqi(x: Column, convention: int = 2012) -> Column:
    """Index of a concentration; above the table the last line goes on, unclamped."""
    return _piecewise(x.cast("double"), list(BREAKPOINTS[convention]))


def aqi_to_pm25(x: Column, convention: int = 2012) -> Column:
    """Concentration of an index, the inverse line by line."""
    return _piecewise(x.cast("double"), [(c, d, a, b) for a, b, c, d in BREAKPOINTS[convention]])


def category_index(x: Column) -> Column:
    """0 to 5; a value belongs to the first category whose top it doesn't pass, so 50 is Good and
    50.5 Moderate; negative values are Good; NaN and values past the last top are Hazardous."""
    out = F.when(x.isNull(), None).when(F.isnan(x), len(CATEGORIES) - 1)
    for i, (top, _) in enumerate(CATEGORIES[:-1]):
        out = out.when(x <= top, i)
    return out.otherwise(len(CATEGORIES) - 1)


def category(x: Column) -> Column:
    index = category_index(x)
    out = F.when(index.isNull(), None)
    for i, (_, name) in enumerate(CATEGORIES):
        out = out.when(index == i, name)
    return out


#: The colours of the categories, in their order.
COLOURS = ("#00e400", "#ffff00", "#ff7e00", "#ff0000", "#8f3f97", "#7e0023")


def category_colour(x: Column) -> Column:
    """The colour that stands for the category of an index; null for null."""
    return F.get(F.array(*map(F.lit, COLOURS)), category_index(x))


def band(x: Column, edges: tuple[float, ...] = BAND_EDGES) -> Column:
    """0 to 5 by lower edges: 50 is in band 1. Null for null and NaN."""
    out = F.when(x.isNull() | F.isnan(x), None)
    for i, edge in enumerate(edges):
        out = out.when(x < edge, i)
    return out.otherwise(len(edges))


def band_label(index: Column, edges: tuple[float, ...] = BAND_EDGES) -> Column:
    lows, highs = (0, *edges), (*edges, "+")
    out = F.when(index.isNull(), None)
    for i, (a, b) in enumerate(zip(lows, highs)):
        out = out.when(index == i, f"{a}-{b}")
    return out


def sql_piecewise(x: str, rows: list[tuple[float, float, float, float]]) -> str:
    """The same in SQL, for comparison."""

    def line(row: tuple[float, float, float, float]) -> str:
        a, b, c, d = map(float, row)
        return f"(({x}) - {a!r}::double) * {(d - c) / (b - a)!r}::double + {c!r}::double"

    whens = " ".join(f"when ({x}) <= {float(r[1])!r}::double then {line(r)}" for r in rows[:-1])
    return f"case when ({x}) is null or isnan(({x})::double) or ({x}) < 0 then null {whens} else {line(rows[-1])} end"


def sql_pm25_to_aqi(x: str, convention: int = 2012) -> str:
    return sql_piecewise(x, list(BREAKPOINTS[convention]))


def sql_aqi_to_pm25(x: str, convention: int = 2012) -> str:
    return sql_piecewise(x, [(c, d, a, b) for a, b, c, d in BREAKPOINTS[convention]])


def sql_category_index(x: str) -> str:
    whens = " ".join(f"when {x} <= {top} then {i}" for i, (top, _) in enumerate(CATEGORIES[:-1]))
    return f"case when {x} is null then null when isnan(({x})::double) then 5 {whens} else 5 end"


def sql_band(x: str) -> str:
    whens = " ".join(f"when {x} < {edge} then {i}" for i, edge in enumerate(BAND_EDGES))
    return f"case when {x} is null or isnan(({x})::double) then null {whens} else {len(BAND_EDGES)} end"
