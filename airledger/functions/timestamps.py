"""Times written in many ways, brought to one UTC instant.

A text is tokenised into a mask of character classes (digit, letter, the sign itself); each
distinct mask is mapped to a parser once, and all texts of one mask are converted together:
fields are cut at fixed places from a byte matrix, wall clocks go through the transition
table of their zone. Nothing is done row by row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .zones import ABBREVIATIONS, ZoneTable, zone_table

#: Once digits beyond the microsecond are taken out, a text longer than this names no time: the
#: longest form with the longest zone name of the database is shorter.
LONGEST = 96

_CLASS = np.full(256, ord("?"), dtype=np.uint8)
for _c in range(32, 127):
    _CLASS[_c] = _c
_CLASS[ord("0") : ord("9") + 1] = ord("9")
_CLASS[ord("A") : ord("Z") + 1] = ord("a")
_CLASS[ord("a") : ord("z") + 1] = ord("a")

#: English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FULL_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
FULL_WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

_DATES = (
    r"(?P<y>9999)-(?P<m>99)-(?P<d>99)",
    r"(?P<y>9999)(?P<sep>[./])(?P<m>99?)(?P=sep)(?P<d>99?)",
    r"(?P<y>9999)-(?P<j>999)",
    r"(?P<p>99?)(?P<sep>[./-])(?P<q>99?)(?P=sep)(?P<y>9999)",
    r"(?:(?P<w>a{3,9}),? )?(?P<d>99?)(?P<sep>[ -])(?P<b>a{3,9})(?P=sep)(?P<y>9999)",
    r"(?:(?P<w>a{3,9}),? )?(?P<b>a{3,9}) (?P<d>99?),? (?P<y>9999)",
)
_TIME = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?"
_ZONE = r"(?: ?(?P<Z>a)| ?(?P<sg>[+-])(?P<oh>99)(?::?(?P<om>99))?(?:\[(?P<br>a[a9/_+-]*)\])?| (?P<zn>a[a9/_+-]+))?"
_FORMS = [
    *(re.compile(f"{d}(?:(?:(?P<T>a)|,? ){_TIME}(?: ?(?P<ap>aa)(?!a))?{_ZONE})?$") for d in _DATES),
    re.compile(r"(?P<y>9999)(?P<m>99)(?P<d>99)(?:(?:(?P<T>a)| )?(?P<H>99)(?P<M>99)(?:(?P<S>99)(?:[.,](?P<f>9+))?)?" + _ZONE + ")?$"),
]
#: Digits of a number of seconds, milliseconds, microseconds or nanoseconds since 1970: the
#: length tells the unit, and the factor to microseconds is 10 to this power.
_EPOCHS = {10: 6, 13: 3, 16: 0, 19: -3}

Fields = dict[str, tuple[int, int]]


#: Parsers already made in this process, by mask; made anew when so many are kept.
_KNOWN: dict[str, tuple[Fields, ...]] = {}
_KEPT = 65536


def plans_for(mask: str) -> tuple[Fields, ...]:
    """The parsers of a mask, made once: where each field stands. None for a mask that names no time."""
    if mask not in _KNOWN:
        if len(_KNOWN) >= _KEPT:
            _KNOWN.clear()
        _KNOWN[mask] = _plans(mask)
    return _KNOWN[mask]


def _plans(mask: str) -> tuple[Fields, ...]:
    if set(mask) == {"9"} and len(mask) in _EPOCHS:
        return ({"epoch": (0, len(mask))},)
    if m := re.fullmatch(r"(9{10})[.,](9+)", mask):
        return ({"epoch": m.span(1), "f": m.span(2)},)
    found: list[Fields] = []
    for form in _FORMS:
        if m := form.match(mask):
            spans = {k: m.span(k) for k, v in m.groupdict().items() if v is not None and k != "sep"}
            found.append(spans)
            if "ap" in spans and "zn" not in spans and "Z" not in spans and "sg" not in spans:
                # two letters may also be a zone
                other = dict(spans)
                other["zn"] = other.pop("ap")
                found.append(other)
    return tuple(found)


def _number(text: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(text), dtype=np.int64)
    for i in range(*span):
        out = out * 10 + (text[:, i] - 48)
    return out


def _tokens(text: np.ndarray, span: tuple[int, int]) -> tuple[list[str], np.ndarray]:
    """Distinct lower-case values of a field, and which each row has."""
    cut = np.ascontiguousarray(text[:, span[0] : span[1]])
    values, which = np.unique(cut.view(f"S{span[1] - span[0]}").ravel(), return_inverse=True)
    return [v.decode("ascii").lower() for v in values], which


def _lookup(text: np.ndarray, span: tuple[int, int], of: Callable[[str], int | None]) -> tuple[np.ndarray, np.ndarray]:
    values, which = _tokens(text, span)
    found = [of(v) for v in values]
    number = np.array([-1 if x is None else x for x in found], dtype=np.int64)[which]
    return number, np.array([x is not None for x in found])[which]


def _index_of(short: tuple[str, ...], full: tuple[str, ...]) -> Callable[[str], int | None]:
    return lambda v: short.index(v) if v in short else full.index(v) if v in full else None


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 in the proleptic Gregorian calendar."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


_DAYS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _run(plan: Fields, text: np.ndarray, zone: np.ndarray, zone_names: list[str | None], order: np.ndarray, zones: ZoneTable) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds since 1970 and whether each text names an instant."""
    n = len(text)
    micros = np.zeros(n, dtype=np.int64)
    if "f" in plan:
        a, b = plan["f"]
        micros = _number(text, (a, min(b, a + 6))) * 10 ** max(0, 6 - (b - a))
    if "epoch" in plan:
        a, b = plan["epoch"]
        value, power = _number(text, (a, b)), _EPOCHS[b - a]
        return (value * 10**power if power >= 0 else value // 10**-power) + micros, np.ones(n, dtype=bool)

    ok = np.ones(n, dtype=bool)
    y = _number(text, plan["y"])
    if "j" in plan:
        j = _number(text, plan["j"])
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        ok &= (j >= 1) & (j <= 365 + leap) & (y >= 1)
        days = days_from_civil(y, np.ones_like(y), np.ones_like(y)) + j - 1
    else:
        if "b" in plan:
            m, good = _lookup(text, plan["b"], _index_of(MONTHS, FULL_MONTHS))
            m, d = m + 1, _number(text, plan["d"])
            ok &= good
        elif "p" in plan:
            p, q = _number(text, plan["p"]), _number(text, plan["q"])
            m, d = np.where(order == 1, q, p), np.where(order == 1, p, q)
            ok &= order > 0  # where the country writes the year first, this form has no order
        else:
            m, d = _number(text, plan["m"]), _number(text, plan["d"])
        ok &= (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1)
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        ok &= d <= _DAYS[np.clip(m, 0, 12)] + ((m == 2) & leap)
        days = days_from_civil(y, np.clip(m, 1, 12), d)
    if "w" in plan:
        wd, good = _lookup(text, plan["w"], _index_of(WEEKDAYS, FULL_WEEKDAYS))
        ok &= good & (wd == (days + 3) % 7)
    if "T" in plan:
        ok &= (text[:, plan["T"][0]] | 32) == ord("t")

    zero = np.zeros(n, dtype=np.int64)
    h, mi, s = (_number(text, plan[k]) if k in plan else zero for k in ("H", "M", "S"))
    if "ap" in plan:
        half, good = _lookup(text, plan["ap"], lambda v: {"am": 0, "pm": 1}.get(v))
        ok &= good & (h >= 1) & (h <= 12)
        h = h % 12 + 12 * np.maximum(half, 0)
    ok &= (h <= 23) & (mi <= 59) & (s <= 59)
    wall = days * 86400 + h * 3600 + mi * 60 + s

    if "Z" in plan:
        ok &= (text[:, plan["Z"][0]] | 32) == ord("z")
        utc = wall
    elif "sg" in plan:
        oh, om = _number(text, plan["oh"]), _number(text, plan["om"]) if "om" in plan else zero
        ok &= (om <= 59) & (oh * 60 + om <= 18 * 60)
        sign = np.where(text[:, plan["sg"][0]] == ord("-"), -1, 1)
        utc = wall - sign * (oh * 3600 + om * 60)
        if "br" in plan:  # the offset decides; the zone must exist
            _, good = _lookup(text, plan["br"], lambda v: 0 if zones.get(v) else None)
            ok &= good
    elif "zn" in plan:
        utc = wall.copy()
        values, which = _tokens(text, plan["zn"])
        for k, name in enumerate(values):
            rows = np.flatnonzero(which == k)
            if (named := zones.get(name)) and ("/" in name or name.upper() not in ABBREVIATIONS):
                utc[rows], real = named.to_utc(wall[rows])
                ok[rows] &= real
                continue
            usual = ABBREVIATIONS.get(name.upper())
            for z in np.unique(zone[rows]):
                own = zones.get(zone_names[z])
                offset = own.abbreviations.get(name.upper()) if own else None
                offset = offset if offset is not None else None if usual is None else usual * 60
                some = rows[zone[rows] == z]
                if offset is None:
                    ok[some] = False
                else:
                    utc[some] = wall[some] - offset
    else:
        utc = wall.copy()
        for z in np.unique(zone):
            rows = np.flatnonzero(zone == z)
            own = zones.get(zone_names[z])
            if own is None:
                ok[rows] = False
            else:
                utc[rows], real = own.to_utc(wall[rows])
                ok[rows] &= real
    return utc * 1_000_000 + micros, ok


def _groups(keys: np.ndarray) -> list[np.ndarray]:
    """Row numbers by distinct key."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(keys[order][1:] != keys[order][:-1]) + 1
    return np.split(order, cuts) if len(order) else []


def parse_times(texts: pa.Array, zone: pa.Array, order: pa.Array, zones: ZoneTable) -> pa.Array:
    """int64 microseconds since 1970 UTC, null where a text names no instant.

    `zone` holds the IANA name of the place whose wall clock a text without a zone shows;
    `order` holds dmy, mdy or ymd. Null in either leaves only texts that don't need it.
    """
    texts = pc.utf8_trim_whitespace(texts.cast(pa.string()))
    long = pc.fill_null(pc.greater(pc.binary_length(texts), LONGEST), False)
    if pc.any(long).as_py():
        texts = pc.if_else(long, pc.replace_substring_regex(texts, r"([.,][0-9]{6})[0-9]+", r"\1"), texts)
    n = len(texts)
    out, good = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    valid = np.asarray(texts.is_valid())
    _, offsets_buffer, data_buffer = texts.buffers()
    if n == 0 or data_buffer is None or not valid.any():
        return pa.nulls(n, pa.int64())
    offsets = np.frombuffer(offsets_buffer, np.int32, n + 1, texts.offset * 4)
    data = np.frombuffer(data_buffer, np.uint8)
    starts, lengths = offsets[:-1].astype(np.int64), np.diff(offsets)
    coded = zone.cast(pa.string()).dictionary_encode()
    names = [*coded.dictionary.to_pylist(), None]
    code = np.asarray(coded.indices.fill_null(len(names) - 1), dtype=np.int64)
    way = np.asarray(pc.index_in(order.cast(pa.string()), pa.array(["ymd", "dmy", "mdy"])).fill_null(0), dtype=np.int64)

    fits = np.flatnonzero(valid & (lengths >= 6) & (lengths <= LONGEST))
    for rows in _groups(lengths[fits]):
        rows = fits[rows]
        length = int(lengths[rows[0]])
        text = data[starts[rows][:, None] + np.arange(length)]
        masks = np.ascontiguousarray(_CLASS[text]).view(f"S{length}").ravel()
        distinct, which = np.unique(masks, return_inverse=True)
        for k, part in enumerate(_groups(which)):
            left, value = part, distinct[which[part[0]]]
            for plan in plans_for(value.decode("ascii")):
                at = rows[left]
                micros, ok = _run(plan, text[left], code[at], names, way[at], zones)
                out[at[ok]], good[at[ok]] = micros[ok], True
                left = left[~ok]
                if not len(left):
                    break
    return pa.array(out, pa.int64(), mask=~good)


def utc_micros(text: Column, zone: Column, order: Column) -> Column:
    """The UTC instant of `text` in microseconds since 1970, or null.

    The driver's zone table (its size bounded by the database) travels with the function.
    It is declared nondeterministic, though it isn't: else a filter on the result would be
    pushed below it and the texts parsed twice. Filters on other columns belong before it.
    """
    table = zone_table()

    @F.arrow_udf("long")
    def parse(text: pa.Array, zone: pa.Array, order: pa.Array) -> pa.Array:
        return parse_times(text, zone, order, table)

    return parse.asNondeterministic()(text, zone, order)


#: The form that needs no conversion.
EXACT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"


def with_instant(df: DataFrame, places: DataFrame, text: str = "date", key: str = "location_id", out: str = "utc_us") -> DataFrame:
    """`df` with the column `out`: the instant that `text` names, else null.

    `places` has one row per `key` with `time_zone` and `date_order`. A row whose key is null
    or unknown keeps its row; its text counts only if it names its own zone and order.
    Null, empty and over-long texts give null. Other columns of `df` pass through, whatever
    their names.
    """
    names = {n: f"__place_{n}" for n in (key, "time_zone", "date_order")}
    small = places.select(*(F.col(k).alias(v) for k, v in names.items()))
    joined = df.join(small, df[key] == small[names[key]], "left")
    return joined.withColumn(out, utc_micros(F.col(text), F.col(names["time_zone"]), F.col(names["date_order"]))).drop(*names.values())
