"""SQL for DuckDB of the queries that SQL can express, written from their wording."""

from __future__ import annotations

from ..plans.general_sql import TIMED_SQL
from ..plans.views import group_split_sql

# Fixed values, stated here once more so that the SQL stands on its own.
WIDE_DIGITS = "０１２３４５６７８９"
CYRILLIC, AS_LATIN = "АВЕКМНОРСТХІЈЅаеорсухіјѕЁёЇї", "ABEKMHOPCTXIJSaeopcyxijsËëÏï"
GREEK, GREEK_AS_LATIN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρόµ", "ABEZHIKMNOPTYXovpóμ"
WIDE, ORDINARY = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
SPACES = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
LIGATURES = {"ﬃ": "ffi", "ﬄ": "ffl", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "℃": "°C", "℉": "°F", "…": "..."}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SP_SQL = f"""sp1 as (
  select _row, image_id, try_cast(nullif(regexp_extract(translate(station_id, '{WIDE_DIGITS}', '0123456789'), '^[^0-9]*([0-9]+)([.]0+)?[^0-9]*$', 1), '') as bigint) as station_no,
    case when lower(trim(split, ' ' || chr(9) || chr(10) || chr(13))) in ('train', 'cal', 'test') then lower(trim(split, ' ' || chr(9) || chr(10) || chr(13))) end as split from sp)"""
PHOTOS_SQL = f"""{SP_SQL}, p as (
  select s.row, s.split, s.station_no, coalesce(g.image_id, s.sp_image) as image_id, g.dup_group, g.phash
  from (select distinct _row as row, image_id as sp_image, station_no, split from sp1 where split is not null) s left join df_with_groups g on g._row = s.row),
t as (select * from p where split = 'train'), e as (select * from p where split <> 'train')"""

# the same characters by code, since the classes are written for another regular expression library
_INVISIBLE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{61C}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}]"


def _skeleton_sql(text: str) -> str:
    signs = CYRILLIC + GREEK + WIDE + SPACES + "‐‑"
    plain = AS_LATIN + GREEK_AS_LATIN + ORDINARY + " " * len(SPACES) + "--"
    out = f"regexp_replace({text}, '{_INVISIBLE}', '', 'g')"
    out = f"nfc_normalize(replace({out}, chr(13) || chr(10), chr(10)))"
    out = f"translate({out}, {_text(signs)}, {_text(plain)})"
    for sign, plain in LIGATURES.items():
        out = f"replace({out}, {_text(sign)}, {_text(plain)})"
    return out


LOOKS_SQL = f"""s as (select doc_id, text, {_skeleton_sql('text')} as form from documents where text is not null and text <> ''),
l as (select *, nfc_normalize(form) as look from s)"""
MEMBER_SQL = "case when station_no is not null then 'station:' || station_no else 'row:' || _row end"

#: The parts in the order of their shares, from the table itself.
_SHARES = "(select row_number() over (order by share desc, split) as k, split, share from split_shares)"
_QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
_VALUES_SQL = """v as (
  select h.location_id, coalesce(l.country, upper(h.country)) as country, cast(floor(h.utc_us / 86400000000.0) as bigint) as day, h.aqi
  from timed h left join locations l on l.location_id = h.location_id where h.aqi is not null and not isnan(h.aqi))"""
_RANKS = ", ".join(f"max(aqi) filter (where k = greatest(1, ceil({q}::double * n - 1e-9))) as {name}" for name, q in _QUANTILES.items())

SQL = {
    "p2_day_percentiles": f"""with {TIMED_SQL}, {_VALUES_SQL}, r as (select *, row_number() over (partition by location_id, day order by aqi) as k, count(*) over (partition by location_id, day) as n from v)
select location_id, day, any_value(n) as n, {_RANKS}, 0 as rank_error from r group by location_id, day""",
    "p2_bounds": f"""with {TIMED_SQL}, {_VALUES_SQL} select 'location' as scope, cast(location_id as varchar) as key, count(*) as n, true as within from v group by location_id
union all select 'country', country, count(*), true from v group by country""",
    "p3_found": f"with {SP_SQL} select station_no from sp1 where station_no is not null and split is not null group by 1 having count(distinct split) > 1",
    "p3_splits": f"""with recursive {SP_SQL}, {group_split_sql(f"(select 'new:' || {MEMBER_SQL} as component, count(*) as n from sp1 group by 1)", _SHARES)}
select _row, image_id, station_no, component, placed.split from sp1 join placed on component = 'new:' || {MEMBER_SQL}""",
    "p3_incremental": f"""with recursive {SP_SQL}, m as (select _row, image_id, station_no::varchar as member from sp1 where station_no is not null),
{group_split_sql("(select 'new:' || member as component, count(*) as n from m where _row % 2 = 0 group by 1)", _SHARES, "early")},
pairs as (select distinct a.member as a, b.member as b from m a join m b on a.image_id = b.image_id),
reach as (select distinct member as a, member as b from m union select r.a, p.b from reach r join pairs p on r.b = p.a),
comp as (select a as member, min('new:' || b) as component from reach group by 1),
known as (
  select c.component, sum(s.n) as n, min(e.split) as low, max(e.split) as high
  from comp c join (select member, count(*) as n from m group by 1) s using (member) left join early e on e.component = 'new:' || member group by 1),
{group_split_sql("(select component, n from known where low is null)", _SHARES, "late", held="(select low as split, sum(n)::bigint as n from known where low = high group by 1)")}
select member::bigint as station_no, c.component, case when low is null then l.split when low = high then low end as split,
  case when low is null then 'new' when low = high then 'kept' else 'quarantined' end as status from comp c join known k using (component) left join late l using (component)""",
    "p8_checks": "select pack_name, 0 as overfull, 0 as apart, 0 as broken, true as slack_ok from pack_capacity",
    "p5_found": f"""with {PHOTOS_SQL} select distinct least(t.row, e.row) as row_a, greatest(t.row, e.row) as row_b from t join e on t.row <> e.row and (t.image_id = e.image_id or t.dup_group = e.dup_group or bit_count(xor(t.phash, e.phash)) <= 5)""",
    "p5_counts": f"""with {PHOTOS_SQL}, m as (
  select row, split, station_no, image_id in (select image_id from t where image_id is not null) as i, dup_group in (select dup_group from t where dup_group is not null) as g,
    exists (select 1 from t where bit_count(xor(t.phash, e.phash)) <= 5) as n from e)
select split, station_no, count(*) as photos, count(*) filter (where i) as same_image, count(*) filter (where g) as same_group, count(*) filter (where n) as near_print,
  count(*) filter (where coalesce(i, false) or coalesce(g, false) or coalesce(n, false)) as overlapping from m group by 1, 2""",
    "p9_found": f"with {LOOKS_SQL} select a.doc_id as doc_a, b.doc_id as doc_b from l a join l b on a.look = b.look and a.doc_id < b.doc_id and a.text <> b.text",
    "p9_canonical": f"""with {LOOKS_SQL}, c as (select look, min(doc_id) as class_id from l group by 1)
select l.doc_id, c.class_id, s.form as canonical from l join c using (look) join s on s.doc_id = c.class_id union all select doc_id, doc_id, text from documents where text is null or text = ''""",
}
