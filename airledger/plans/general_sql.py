"""SQL for DuckDB of the queries of problems 1, 4 and 6, written from their wording."""

from __future__ import annotations

from ..functions.zones import ABBREVIATIONS

_MINUTES = " ".join(f"when '{name}' then {minutes}" for name, minutes in ABBREVIATIONS.items())
_SHOWN = """case when {z} is null or {w} is null then null
    when timezone({z}, timezone({z}, {w}) - interval 60 minute) = {w} then epoch_us(timezone({z}, {w}) - interval 60 minute)
    when timezone({z}, timezone({z}, {w}) - interval 30 minute) = {w} then epoch_us(timezone({z}, {w}) - interval 30 minute)
    when timezone({z}, timezone({z}, {w})) = {w} then epoch_us(timezone({z}, {w})) end"""

#: Relation `timed`: hourly with `utc_us`.
TIMED_SQL = f"""h0 as (
  select h.*, l.time_zone as tz, l.date_order as ord, trim(h.date, ' ' || chr(9) || chr(10) || chr(13)) as s from hourly h left join locations l on l.location_id = h.location_id),
h1 as (
  select *, regexp_replace(s, '(:[0-9]{{2}})[.,][0-9]+', '\\1') as c,
    cast(rpad(substr(coalesce(nullif(regexp_extract(s, ':[0-9]{{2}}[.,]([0-9]+)', 1), ''), '0'), 1, 6), 6, '0') as bigint) as micros from h0),
h2 as (
  select *, regexp_extract(c, '^(.*:[0-9]{{2}}) ?([+-])([0-9]{{2}}):?([0-9]{{2}})?(\\[[A-Za-z_/]+\\])?$', ['w', 'sg', 'oh', 'om', 'br']) as off,
    regexp_extract(c, '^(.*[0-9]) ([A-Z]{{3,5}})$', ['w', 'ab']) as zab,
    regexp_extract(c, '^(.*[0-9]) ([A-Za-z]+/[A-Za-z_/]+)$', ['w', 'zn']) as zna from h1),
h3 as (
  select *, case
    when s is null then null
    when regexp_full_match(s, '[0-9]{{10}}|[0-9]{{13}}|[0-9]{{16}}') then 'epoch'
    when regexp_full_match(c, '.*[0-9][Zz]') then 'utc'
    when off.w <> '' then 'offset'
    when zab.w <> '' and (zab.ab = 'IST' and tz = 'Asia/Kolkata' or zab.ab in ({', '.join(f"'{n}'" for n in ABBREVIATIONS)})) then 'short'
    when zna.w <> '' and zna.zn in (select name from pg_timezone_names()) then 'zone'
    else 'local' end as kind from h2),
h4 as (
  select *, case kind
    when 'utc' then coalesce(try_strptime(upper(c), '%Y-%m-%dT%H:%M:%SZ'), try_strptime(c, '%Y%m%dT%H%M%SZ'), try_strptime(c, '%Y-%jT%H:%M:%SZ'))
    when 'offset' then try_strptime(off.w, ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M', '%a, %d %b %Y %H:%M:%S'])
    when 'short' then try_strptime(zab.w, ['%Y-%m-%d %H:%M:%S', '%d-%b-%Y %H:%M:%S', '%a, %d %b %Y %H:%M:%S'])
    when 'zone' then try_strptime(zna.w, '%Y-%m-%d %H:%M:%S')
    when 'local' then coalesce(
      try_strptime(c, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M', '%Y%m%d%H%M%S', '%Y/%m/%d %I:%M:%S %p', '%Y/%m/%d %H:%M:%S', '%Y/%m/%d %H:%M', '%Y.%m.%d %H:%M:%S', '%d %b %Y, %H:%M']),
      case ord when 'dmy' then try_strptime(c, ['%d/%m/%Y %I:%M:%S %p', '%d.%m.%Y %H:%M:%S', '%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M'])
               when 'mdy' then try_strptime(c, ['%m/%d/%Y %I:%M:%S %p', '%m.%d.%Y %H:%M:%S', '%m/%d/%Y %H:%M:%S', '%m/%d/%Y %H:%M']) end)
    end as wall from h3),
timed as (
  select * exclude (s, c, off, zab, zna, wall, kind, micros, tz, ord), case kind
    when 'epoch' then try_cast(s as bigint) * case length(s) when 10 then 1000000 when 13 then 1000 else 1 end
    when 'utc' then epoch_us(wall) + micros
    when 'offset' then epoch_us(wall) + micros - (case off.sg when '-' then -1 else 1 end) * (coalesce(try_cast(off.oh as bigint), 0) * 3600 + coalesce(try_cast(off.om as bigint), 0) * 60) * 1000000
    when 'short' then epoch_us(wall) + micros - case zab.ab when 'IST' then 330 {_MINUTES} end::bigint * 60000000
    when 'zone' then {_SHOWN.format(z="zna.zn", w="wall")} + micros
    when 'local' then {_SHOWN.format(z="tz", w="wall")} + micros end as utc_us from h4)"""

_ONE = """one as (
  select sensor_id, utc_us as t, arg_min(aqi, reading_id) as x from timed where utc_us is not null and aqi is not null and not isnan(aqi) group by 1, 2)"""
_HOURS = "hours as (select sensor_id, cast(floor(t / 3600000000.0) as bigint) as h, avg(x) as x from one group by 1, 2)"
_TEXT = "strftime(timestamp '1970-01-01' + to_hours({h}), '%Y-%m-%dT%H:%M:%SZ')"
_PAIRS = "pairs as (select sensor_id, h, x, lead(h) over w as nh, lead(x) over w as nx from hours window w as (partition by sensor_id order by h))"

SQL = {
    "p6_found": f"""with {TIMED_SQL} select reading_id, utc_us from timed where utc_us is not null and not regexp_full_match(date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z')""",
    "p6_instants": f"with {TIMED_SQL} select reading_id, utc_us from timed",
    "p1_found": f"""with {TIMED_SQL}, {_ONE}, {_HOURS}, span as (select sensor_id, min(h) as lo, max(h) as hi from hours group by 1),
every as (select sensor_id, unnest(range(lo, hi)) as h from span)
select sensor_id, {_TEXT.format(h='h')} as hour_utc from every anti join hours using (sensor_id, h)""",
    "p1_grid": f"""with {TIMED_SQL}, {_ONE}, {_HOURS}, {_PAIRS}, g as (select *, unnest(range(h + 1, nh)) as hh from pairs where nh - h > 1)
select sensor_id, {_TEXT.format(h='h')} as hour_utc, round(x, 6) as aqi, 'observed' as status, 0 as gap_hours from hours
union all select sensor_id, {_TEXT.format(h='hh')}, case when nh - h - 1 <= 6 then round(x + (nx - x) * (hh - h) / (nh - h), 6) end, case when nh - h - 1 <= 6 then 'filled' else 'gap' end, nh - h - 1 from g""",
}
_MARKED = f"""{TIMED_SQL}, {_ONE},
placed as (select *, x between 0 and 600 as fine, row_number() over w - row_number() over (partition by sensor_id, x order by t) as island from one window w as (partition by sensor_id order by t)),
runs as (select sensor_id, t from (select *, count(*) over (partition by sensor_id, x, island) as n from placed where fine) where n >= 8),
f as (select sensor_id, t, x, lag(x) over w as b, lead(x, 1) over w as n1, lead(x, 2) over w as n2, lead(x, 3) over w as n3 from placed where fine window w as (partition by sensor_id order by t)),
u as (select sensor_id, 10 * median(abs(x - b)) as m from f where b is not null group by 1),
st as (select f.sensor_id, t,
  greatest(x - greatest(b, n1), least(b, n1) - x) > m and b is not null and n1 is not null as s1,
  greatest(least(x, n1) - greatest(b, n2), least(b, n2) - greatest(x, n1)) > m and b is not null and n2 is not null as s2,
  greatest(least(x, n1, n2) - greatest(b, n3), least(b, n3) - greatest(x, n1, n2)) > m and b is not null and n3 is not null as s3 from f join u using (sensor_id)),
spikes as (select sensor_id, t from (select sensor_id, t, coalesce(s1, false) or coalesce(s2, false) or coalesce(s3, false) or coalesce(lag(s2) over w, false) or coalesce(lag(s3) over w, false) or coalesce(lag(s3, 2) over w, false) as hit
  from st window w as (partition by sensor_id order by t)) where hit),
flags as (
  select reading_id, 'range' as reason from timed where aqi is not null and not isnan(aqi) and not aqi between 0 and 600
  union select reading_id, 'stuck' from timed join runs on timed.sensor_id = runs.sensor_id and utc_us = t where aqi between 0 and 600
  union select reading_id, 'spike' from timed join spikes on timed.sensor_id = spikes.sensor_id and utc_us = t where aqi between 0 and 600)"""
SQL["p4_found"] = f"with {_MARKED} select distinct reading_id from flags"
SQL["p4_flags"] = f"with {_MARKED} select reading_id, reason from flags"
