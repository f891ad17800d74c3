"""Plain row-by-row versions of the operators, for comparison on small tables."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from statistics import median
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
ABBR = {"UTC": 0, "GMT": 0, "AEST": 600, "AEDT": 660, "CEST": 120, "CET": 60, "IST": 330, "WET": 0, "WEST": 60, "EDT": -240, "EST": -300, "MDT": -360, "MST": -420, "EEST": 180, "EET": 120}
WALL = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y%m%d%H%M%S", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d %H:%M", "%Y.%m.%d %H:%M:%S", "%Y/%m/%d %I:%M:%S %p", "%d %b %Y, %H:%M"]
BY_ORDER = {
    "dmy": ["%d.%m.%Y %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%d/%m/%Y %I:%M:%S %p"],
    "mdy": ["%m.%d.%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%m/%d/%Y %I:%M:%S %p"],
    "ymd": [],
}
ZONED = ["%Y-%m-%d %H:%M:%S", "%d-%b-%Y %H:%M:%S", "%a, %d %b %Y %H:%M:%S"]


def strip_fraction(s: str) -> tuple[str, int]:
    if m := re.search(r"(:\d\d)[.,](\d+)", s):
        return s[: m.end(1)] + s[m.end() :], int(m[2][:6].ljust(6, "0"))
    return s, 0


def shown(wall: datetime, zone: str) -> datetime | None:
    utc = wall.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc)
    return utc if utc.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == wall else None


def tried(s: str, formats: list[str]) -> datetime | None:
    for f in formats:
        try:
            return datetime.strptime(s, f)
        except ValueError:
            pass
    return None


def instant(text: str | None, zone: str | None, order: str | None) -> int | None:
    if text is None:
        return None
    s = text.strip()
    if re.fullmatch(r"\d{10}|\d{13}|\d{16}", s):
        return int(s) * {10: 10**6, 13: 10**3, 16: 1}[len(s)]
    s, micros = strip_fraction(s)
    utc = None
    if re.fullmatch(r"\d{4}.*[zZ]", s):
        wall = tried(s[:-1].replace("t", "T"), ["%Y-%m-%dT%H:%M:%S", "%Y%m%dT%H%M%S", "%Y-%jT%H:%M:%S"])
        utc = wall and wall.replace(tzinfo=timezone.utc)
    elif m := re.fullmatch(r"(.*\d\d:\d\d) ?([+-])(\d\d):?(\d\d)?(\[.*\])?", s):
        wall = tried(m[1], ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S", "%a, %d %b %Y %H:%M:%S"])
        off = timedelta(hours=int(m[3]), minutes=int(m[4] or 0)) * (-1 if m[2] == "-" else 1)
        utc = wall and (wall - off).replace(tzinfo=timezone.utc)
    elif (m := re.fullmatch(r"(.*) ([A-Z]{3,4})", s)) and m[2] in ABBR:
        wall = tried(m[1], ZONED)
        utc = wall and (wall - timedelta(minutes=ABBR[m[2]])).replace(tzinfo=timezone.utc)
    elif m := re.fullmatch(r"(.*) ([A-Z]\w+/\w+)", s):
        wall = tried(m[1], ["%Y-%m-%d %H:%M:%S"])
        utc = wall and shown(wall, m[2])
    else:
        wall = tried(s, WALL + BY_ORDER.get(order or "", []))
        utc = wall and zone and shown(wall, zone)
    return None if not utc else (utc - EPOCH) // timedelta(microseconds=1) + micros


def number(x) -> bool:
    return x is not None and not math.isnan(x)


def missing(rows: list[tuple[int, int | None, float | None]]) -> set[tuple[int, int]]:
    """(sensor, hour) without a reading between the first and last of (sensor, t, x)."""
    hours = defaultdict(set)
    for sensor, t, x in rows:
        if t is not None and number(x):
            hours[sensor].add(t // 3_600_000_000)
    return {(s, h) for s, hs in hours.items() for h in range(min(hs), max(hs)) if h not in hs}


def implausible(rows: list[tuple[int, int, int | None, float | None]]) -> set[int]:
    """Ids of (id, sensor, t, x) by the wording of the three rules."""
    out = {i for i, _, _, x in rows if number(x) and (x < 0 or x > 600)}
    series = defaultdict(dict)
    for i, s, t, x in sorted(rows, key=lambda r: r[0]):
        if t is not None and number(x):
            series[s].setdefault(t, [x, []])[1].append((i, x))
    for values in series.values():
        times = sorted(values)
        xs = [values[t][0] for t in times]
        bad = set()
        k = 0
        while k < len(xs):
            j = k
            while j + 1 < len(xs) and xs[j + 1] == xs[k]:
                j += 1
            if j - k + 1 >= 8:
                bad |= set(times[k : j + 1])
            k = j + 1
        fine = [(t, x) for t, x in zip(times, xs) if 0 <= x <= 600]
        if len(fine) >= 3:
            v = [x for _, x in fine]
            usual = median(abs(b - a) for a, b in zip(v, v[1:]))
            for a in range(1, len(v) - 1):
                for w in (1, 2, 3):
                    if a + w < len(v):
                        run, before, after = v[a : a + w], v[a - 1], v[a + w]
                        if min(run) - max(before, after) > 10 * usual or min(before, after) - max(run) > 10 * usual:
                            bad |= {t for t, _ in fine[a : a + w]}
        out |= {i for t in bad for i, _ in values[t][1]}
    return out
