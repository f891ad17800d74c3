"""Zone transition tables read from the compiled time zone database.

The driver reads every zone once into plain arrays and ships them to the executors, so that
all tasks of a job use one version of the rules. The size is bounded by the database
(some 600 zones, transitions up to `HORIZON`), not by the data.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zoneinfo
from calendar import monthrange
from dataclasses import dataclass, field
from datetime import date

import numpy as np

#: The rule at the end of a zone's file is written out up to this year; later wall clocks
#: keep the last offset.
HORIZON = 2100

#: Abbreviations with one usual meaning, in minutes east of UTC. Those with
#: several meanings (IST, BST, ...) only count where the location's own zone uses them.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0,
    "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780,
}


@dataclass
class Zone:
    """UTC seconds of the transitions; offsets[i] holds before transition i."""

    at: np.ndarray
    offsets: np.ndarray
    abbreviations: dict[str, int]
    #: Wall clock second from which the later offset holds, taking the first of two.
    wall: np.ndarray = field(init=False)
    gap_from: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        before, after = self.offsets[:-1], self.offsets[1:]
        self.wall = self.at + np.maximum(before, after)
        self.gap_from = self.at + before

    def to_utc(self, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTC seconds of wall clock seconds, and whether the clock ever shows them.

        A time shown twice means the first; a time skipped by a jump isn't shown.
        """
        k = np.searchsorted(self.wall, wall, side="right")
        real = np.ones(len(wall), dtype=bool)
        if len(self.at):
            nxt = np.minimum(k, len(self.at) - 1)
            real = (k == len(self.at)) | (self.offsets[nxt + 1] <= self.offsets[nxt]) | (wall < self.gap_from[nxt])
        return wall - self.offsets[k], real


def _posix_day(rule: str, year: int) -> int:
    """Days since 1970 of a rule's day (Mm.w.d, Jn or n) in `year`."""
    first = date(year, 1, 1).toordinal() - 719163
    if rule[0] == "M":
        m, w, d = map(int, rule[1:].split("."))
        weekday, days = monthrange(year, m)
        day = 1 + (d - (weekday + 1) % 7) % 7 + 7 * (w - 1)
        return date(year, m, day - 7 if day > days else day).toordinal() - 719163
    if rule[0] == "J":
        n = int(rule[1:])
        return first + n - 1 + (n >= 60 and monthrange(year, 2)[1] == 29)
    return first + int(rule)


def _posix_seconds(text: str) -> int:
    sign = -1 if text[:1] == "-" else 1
    parts = [int(x) for x in text.lstrip("+-").split(":")]
    return sign * sum(x * s for x, s in zip(parts, (3600, 60, 1)))


_NAME = r"(?:<([^>]+)>|([A-Za-z]+))"
_FOOTER = re.compile(
    rf"{_NAME}([+-]?[\d:]+)(?:{_NAME}([+-]?[\d:]+)?,([^,/]+)(?:/([+-]?[\d:]+))?,([^,/]+)(?:/([+-]?[\d:]+))?)?$"
)


def parse_tzif(data: bytes, horizon: int = HORIZON) -> Zone:
    """A zone from a TZif file of version 2 or later."""
    if data[:4] != b"TZif" or data[4:5] < b"2":
        raise ValueError("not a TZif file of version 2 or later")

    def counts(at: int) -> tuple[int, ...]:
        return struct.unpack(">6l", data[at + 20 : at + 44])

    utc, std, leap, times, types, chars = counts(0)
    head = 44 + times * 5 + types * 6 + chars + leap * 8 + std + utc
    utc, std, leap, times, types, chars = counts(head)
    p = head + 44
    at = np.frombuffer(data, ">i8", times, p).astype(np.int64)
    which = np.frombuffer(data, np.uint8, times, p + 8 * times)
    p += 9 * times
    kinds = [struct.unpack(">lBB", data[p + 6 * i : p + 6 * i + 6]) for i in range(types)]
    names = data[p + 6 * types : p + 6 * types + chars]
    label = [names[k[2] : names.index(b"\0", k[2])].decode() for k in kinds]
    p += 6 * types + chars + 12 * leap + std + utc
    footer = data[p:].decode().strip("\n")
    first = next((i for i, k in enumerate(kinds) if not k[1]), 0)
    offsets = [kinds[first][0], *(kinds[i][0] for i in which)]
    seen = [label[first], *(label[i] for i in which)]
    abbreviations = {a: o for a, o in zip(seen, offsets)}
    more_at: list[int] = []
    if m := _FOOTER.match(footer):
        standard = -_posix_seconds(m[3])
        abbreviations[m[1] or m[2]] = standard
        if m[7]:
            daylight = -_posix_seconds(m[6]) if m[6] else standard + 3600
            abbreviations[m[4] or m[5]] = daylight
            last = int(at[-1]) if times else -(2**62)
            start = max(1900, 1970 + last // 31556952 - 1) if times else 1900
            for year in range(start, horizon + 1):
                jumps = [
                    (_posix_day(m[7], year) * 86400 + _posix_seconds(m[8] or "2") - standard, daylight),
                    (_posix_day(m[9], year) * 86400 + _posix_seconds(m[10] or "2") - daylight, standard),
                ]
                for when, offset in sorted(jumps):
                    if when > last:
                        more_at.append(when)
                        offsets.append(offset)
    return Zone(np.concatenate([at, np.array(more_at, dtype=np.int64)]), np.array(offsets, dtype=np.int64), abbreviations)


@dataclass
class ZoneTable:
    """All zones of one version of the database, by lower-case name."""

    version: str
    zones: dict[str, Zone]

    def get(self, name: str | None) -> Zone | None:
        return self.zones.get(name.lower()) if name else None


def _version() -> str:
    for root in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            try:
                with open(os.path.join(root, name)) as f:
                    return f.readline().replace("# version", "").strip()
            except OSError:
                pass
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


def _bytes_of(name: str) -> bytes | None:
    for root in zoneinfo.TZPATH:
        try:
            with open(os.path.join(root, name), "rb") as f:
                return f.read()
        except OSError:
            pass
    try:
        from importlib import resources

        return resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()
    except (ImportError, OSError):
        return None


@functools.cache
def zone_table() -> ZoneTable:
    """The driver's database, read once in a process."""
    zones = {}
    for name in zoneinfo.available_timezones():
        data = _bytes_of(name)
        if data and data[4:5] >= b"2":
            zones[name.lower()] = parse_tzif(data)
    return ZoneTable(_version(), zones)
