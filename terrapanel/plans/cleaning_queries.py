"""Cleaning, source and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.functions.columns import backfill_coordinate, day_of_year_to_date, epoch_ms_to_local_text, normalise_confidence, right_closed_bin, strip_units
from terrapanel.operators.cleaning import ALIASES, clean_detections, clean_point_incidents, clean_portal_incidents, dedupe_events, incident_filter, resolve_columns
from terrapanel.plans import roles
from terrapanel.plans.catalog import register
from terrapanel.plans.roles import place, place_sql, table
from terrapanel.sources.links import absolute_url, anchor_links, harvest_links, partition_manifest, pick_version, prune_by_date
from terrapanel.sources.tabular import body_lines, factor_of


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


_STATE = "case when o_orderstatus = 'F' then 'US-CA' when o_orderstatus = 'O' then 'CA' else 'US-NV' end"
_TYPE = "case when o_orderpriority = '1-URGENT' then 'RX' else 'WF' end"


def _portal(spark, sf_dir):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    spot = place("o_custkey")
    return _orders(spark, sf_dir).select(
        F.when(k % 13 != 0, F.concat(F.lit("I"), F.col("o_custkey"))).alias("IrwinID"),
        F.col("o_orderpriority").alias("IncidentName"),
        F.when(k % 17 != 0, spot["lat"]).alias("InitialLatitude"),
        spot["lon"].alias("InitialLongitude"),
        F.when(status == "F", "US-CA").when(status == "O", "CA").otherwise("US-NV").alias("POOState"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "RX").otherwise("WF").alias("IncidentTypeCategory"),
        F.when(k % 19 == 0, "not a date").otherwise(F.col("o_orderdate").cast("string")).alias("FireDiscoveryDateTime"),
    )


_PORTAL = f"""portal as (select case when o_orderkey % 13 <> 0 then 'I' || o_custkey end as incident_id, case when o_orderkey % 17 <> 0 then lat end as lat, lon, {_STATE} as state, {_TYPE} as type,
  case when o_orderkey % 19 <> 0 then cast(o_orderdate as date) end as date, o_orderkey from (select *, {place_sql('o_custkey')} from orders))"""


@register(
    "incident_clean",
    "incident_id:s date:d lat:f6 lon:f6 state:s type:s",
    f"""with {_PORTAL} select * from (select *, row_number() over (partition by incident_id order by date, lat, lon) as rn from portal
    where state = 'US-CA' and type = 'WF' and lat is not null and date is not null) where rn = 1""",
)
def incident_clean(spark, sf_dir):
    return clean_portal_incidents(_portal(spark, sf_dir))


@register(
    "incident_points",
    "incident_id:s date:d lat:f6 lon:f6",
    f"""with p as (select 'I' || o_custkey as incident_id, cast(o_orderdate as date) as date, case when o_orderkey % 5 = 0 then lat + 0.25e0 else lat end as lat, lon, {_STATE} as state from (select *, {place_sql('o_custkey')} from orders))
    select incident_id, date, round_even(lat, 6) as lat, round_even(lon, 6) as lon from (select *, row_number() over (partition by incident_id order by date, lat, lon) as rn from p
    where date between date '1996-01-01' and date '1998-12-31' and state = 'US-CA' and lon between {roles.BBOX[0]}e0 and {roles.BBOX[2]}e0 and lat between {roles.BBOX[1]}e0 and {roles.BBOX[3]}e0) where rn = 1""",
)
def incident_points(spark, sf_dir):
    """Every fifth incident lacks its latitude (missing or zero) and falls back to y."""
    k = F.col("o_orderkey")
    lat, lon = place("o_custkey").values()
    raw = _orders(spark, sf_dir).select(
        F.concat(F.lit("I"), F.col("o_custkey")).alias("IrwinID"),
        F.col("o_orderdate").cast("string").alias("FireDiscoveryDateTime"),
        F.when(k % 10 == 0, F.lit(None)).when(k % 5 == 0, F.lit("0")).otherwise(lat.cast("string")).alias("InitialLatitude"),
        lon.cast("string").alias("InitialLongitude"),
        (lat + 0.25).alias("y"),
        lon.alias("x"),
        F.when(F.col("o_orderstatus") == "F", "US-CA").otherwise("US-NV").alias("POOState"),
    )
    return clean_point_incidents(raw, "1996-01-01", "1998-12-31", roles.BBOX)


@register(
    "event_dedupe",
    "incident_id:s date:d lat:f6 lon:f6",
    f"""with {_PORTAL} select * from (select *, row_number() over (partition by incident_id, date order by lat nulls first, lon) as rn from portal) where rn = 1""",
)
def event_dedupe(spark, sf_dir):
    named = _portal(spark, sf_dir).select(
        F.col("IrwinID").alias("incident_id"), F.col("FireDiscoveryDateTime").try_cast("timestamp").cast("date").alias("date"), F.col("InitialLatitude").alias("lat"), F.col("InitialLongitude").alias("lon")
    )
    return dedupe_events(named)


_DET_KEY = "(l_suppkey * 1000 + l_linenumber)"


@register(
    "detection_clean",
    "date:d lat:f6 lon:f6 confidence:l",
    f"""with d as (select cast(l_shipdate as date) as date, l_returnflag as flag, {place_sql(_DET_KEY)} from lineitem)
    select date, round_even(lat, 6) as lat, round_even(lon, 6) as lon, min(case flag when 'N' then 66 else 90 end) as confidence from d
    where flag in ('N', 'R') and lon between {roles.BBOX[0]}e0 and {roles.BBOX[2]}e0 and lat between {roles.BBOX[1]}e0 and {roles.BBOX[3]}e0 group by 1, 2, 3""",
)
def detection_clean(spark, sf_dir):
    flag = F.col("l_returnflag")
    spot = place("l_suppkey * 1000 + l_linenumber")
    raw = table(spark, sf_dir, "lineitem").select(
        spot["lat"].alias("latitude"),
        spot["lon"].alias("longitude"),
        F.col("l_shipdate").cast("date").cast("string").alias("acq_date"),
        F.when(flag == "A", "L").when(flag == "N", "n").otherwise("H").alias("confidence"),
    )
    return clean_detections(raw, roles.BBOX)


_CONF = "case when l_returnflag = 'A' and l_linenumber % 2 = 0 then 'Low' when l_returnflag = 'A' then 'NOMINAL' when l_returnflag = 'R' and l_linenumber % 2 = 0 then 'h' when l_linenumber = 5 then 'other' else cast(l_quantity * 2 as varchar) end"


@register(
    "confidence_norm",
    "l_orderkey:l l_linenumber:l l_partkey:l level:l bin:l",
    f"""select l_orderkey, l_linenumber, l_partkey, case when lower({_CONF}) in ('l', 'low') then 0 when lower({_CONF}) in ('n', 'nominal') then 1 when lower({_CONF}) in ('h', 'high') then 2
    when try_cast({_CONF} as double) > 79.999 then 2 when try_cast({_CONF} as double) > 49.999 then 1 else 0 end as level,
    case when l_quantity * 2 <= 49.999 then 0 when l_quantity * 2 <= 79.999 then 1 else 2 end as bin from lineitem""",
)
def confidence_norm(spark, sf_dir):
    flag, n, amount = F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_quantity") * 2
    text = (
        F.when((flag == "A") & (n % 2 == 0), "Low").when(flag == "A", "NOMINAL").when((flag == "R") & (n % 2 == 0), "h").when(n == 5, "other").otherwise(amount.cast("string"))
    )
    items = table(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", "l_partkey", normalise_confidence(text).alias("level"), right_closed_bin(amount, (-1.0, 49.999, 79.999, 1e9)).alias("bin"))


@register(
    "incident_filter",
    "o_orderkey:l",
    """select o_orderkey from orders where o_orderdate + to_hours(o_orderkey % 24) between timestamp '1997-03-01 08:00:00' and timestamp '1997-07-16 06:59:59' and o_orderpriority in ('1-URGENT', '2-HIGH')
    and (case when o_custkey % 2 = 0 then 'US-' || o_orderstatus else o_orderstatus end) in ('US-F', 'F', 'US-O') and o_custkey % 5 <> 0 and o_totalprice > 1000
    and (o_orderkey % 3 = 0 or o_orderkey % 3 = 2 or o_custkey % 2 = 0)""",
)
def incident_filter_query(spark, sf_dir):
    """Local days across the spring clock change, states with and without prefix, and the record status tests."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    incidents = _orders(spark, sf_dir).select(
        k,
        F.timestamp_add("HOUR", (k % 24).cast("int"), F.col("o_orderdate").cast("timestamp")).alias("FireDiscoveryDateTime"),
        F.col("o_orderpriority").alias("IncidentTypeCategory"),
        F.when(c % 2 == 0, F.concat(F.lit("US-"), "o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("POOState"),
        F.when(c % 5 != 0, "DEFAULT").alias("ADSPermissionState"),
        (F.col("o_totalprice") > 1000).cast("int").alias("IsValid"),
        F.when(k % 3 == 1, 1).when(k % 3 == 2, 0).alias("IsQuarantined"),
        (c % 2).alias("IsQuarantinedInIRWIN"),
    )
    return incident_filter(
        incidents, ("1997-03-01", "1997-07-15"), states=["F", " US-O"], types=["1-URGENT", "2-HIGH"], status=["public", "valid", "released"]
    )


# Pacific summer time 1995-2001: first Sunday of April 10:00 UTC to last Sunday of October 09:00 UTC.
_DST = """(t >= date_trunc('year', t) + interval 3 month + to_days(cast((7 - dayofweek(date_trunc('year', t) + interval 3 month)) % 7 as integer)) + interval 10 hour
  and t < date_trunc('year', t) + interval 9 month + interval 30 day - to_days(cast(dayofweek(date_trunc('year', t) + interval 9 month + interval 30 day) as integer)) + interval 9 hour)"""


@register(
    "epoch_to_local",
    "o_orderkey:l local_text:s",
    f"""with e as (select o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) as t from orders), l as (select o_orderkey, t - case when {_DST} then interval 7 hour else interval 8 hour end as l from e)
    select o_orderkey, month(l) || '/' || day(l) || '/' || year(l) || ' ' || case when hour(l) % 12 = 0 then 12 else hour(l) % 12 end || ':' || lpad(cast(minute(l) as varchar), 2, '0') || ':' || lpad(cast(second(l) as varchar), 2, '0')
    || case when hour(l) < 12 then ' AM' else ' PM' end as local_text from l""",
)
def epoch_to_local(spark, sf_dir):
    k = F.col("o_orderkey")
    ms = (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 86400) * 1000
    return _orders(spark, sf_dir).select(k, epoch_ms_to_local_text(ms).alias("local_text"))


@register("doy_to_date", "o_orderkey:l date:d", "select o_orderkey, cast(o_orderdate as date) as date from orders")
def doy_to_date(spark, sf_dir):
    parts = _orders(spark, sf_dir).select("o_orderkey", F.year("o_orderdate").alias("YEAR"), F.dayofyear("o_orderdate").alias("DOY"))
    return parts.select("o_orderkey", day_of_year_to_date(F.col("YEAR"), F.col("DOY")).alias("date"))


@register(
    "coalesce_coords",
    "c_custkey:l lat:f6",
    "select c_custkey, case when c_custkey % 4 < 3 then c_acctbal else case when c_acctbal = 0 then 7.5 else c_custkey + 0.5e0 end end as lat from customer",
)
def coalesce_coords(spark, sf_dir):
    """Missing, zero and unreadable primaries fall back to the secondary."""
    k = F.col("c_custkey")
    primary = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.lit("0.0")).when(k % 4 == 2, F.lit("n/a")).otherwise((k + 0.5).cast("string"))
    return table(spark, sf_dir, "customer").select(k, backfill_coordinate(primary, F.col("c_acctbal")).alias("lat"))


_UNITS = "case when p_partkey % 10 = 0 then 'n/a' when p_partkey % 11 = 0 then '1e-05' else (p_partkey + 1) || ',' || lpad(cast(p_size as varchar), 3, '0') || '.5 degrees_north' end"


@register(
    "units_strip_cast",
    "p_partkey:l elev:f6",
    f"select p_partkey, try_cast(replace(regexp_replace({_UNITS}, '[A-Za-z_ ]+', '', 'g'), ',', '') as double) as elev from part",
)
def units_strip_cast(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 10 == 0, "n/a").when(k % 11 == 0, "1e-05").otherwise(F.concat(k + 1, F.lit(","), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(".5 degrees_north")))
    return table(spark, sf_dir, "part").select(k, strip_units(text).alias("elev"))


@register("alias_resolve", "lat:f6 lon:f6 date:d", f"select lat, lon, date from (select cast(o_orderdate as date) as date, {place_sql('o_custkey')} from orders)")
def alias_resolve(spark, sf_dir):
    spot = place("o_custkey")
    renamed = _orders(spark, sf_dir).select(spot["lat"].alias("InitialLatitude"), spot["lon"].alias("Longitude"), F.col("o_orderdate").cast("date").alias("discovery_date"))
    return resolve_columns(renamed, ALIASES, required=("lat", "lon", "date"))


# Anchors' addresses, as one list per page, quotes taken off.
_HREF_SQL = (
    """list_transform(regexp_extract_all(html, '(?i)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1), """
    """lambda q: replace(trim(q, '"'''), '&amp;', '&'))"""
)


@register(
    "link_harvest",
    "url:s",
    f"""with l as (select url as page, unnest({_HREF_SQL}) as link from pages)
    select distinct case when starts_with(link, 'http') then link else rtrim(page, '/') || '/' || ltrim(link, '/') end as url from l where lower(link) like '%e'""",
)
def link_harvest(spark, sf_dir):
    return harvest_links(table(spark, sf_dir, "pages"), "E")


@register(
    "link_resolve",
    "page_id:l url:s",
    f"""with l as (select page_id, regexp_extract(url, '^([^?#]*/)', 1) as folder, regexp_extract(url, '^([^:]*://[^/?#]*)', 1) as root, unnest({_HREF_SQL}) as link from pages)
    select page_id, case page_id % 4 when 0 then folder || ltrim(link, '/') when 1 then folder || ltrim(link, '/') || '?C=N'
      when 2 then root || link else case when regexp_matches(folder, '://[^/]*/$') then folder else regexp_replace(folder, '[^/]+/$', '') end || ltrim(link, '/') end as url from l""",
)
def link_resolve(spark, sf_dir):
    """Links read as relative to their page's folder, to its root, and to the folder above."""
    found = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page"), F.explode(anchor_links(F.col("html"))).alias("link"))
    name, turn = F.ltrim(F.col("link"), F.lit("/")), F.col("page_id") % 4
    link = F.when(turn == 0, F.concat(F.lit("./"), name)).when(turn == 1, F.concat(name, F.lit("?C=N"))).when(turn == 2, F.col("link")).otherwise(F.concat(F.lit("../"), name))
    return found.select("page_id", absolute_url(F.col("page"), link).alias("url"))


@register(
    "version_pick",
    "date:d version:s url:s",
    """with f as (select cast(o_orderdate as date) as date, case when o_orderkey % 3 = 0 then 'v001' else 'v002' end as version, 'https://archive.example/' || year(o_orderdate) || '/LAND_' || case when o_orderkey % 3 = 0 then 'v001' else 'v002' end || '_'
      || strftime(o_orderdate, '%Y%m%d') || '_c' || o_orderkey || '.nc' as url from orders)
    select * from (select *, row_number() over (partition by date order by case when version = 'v001' then 0 else 1 end, url) as rn from f where month(date) between 6 and 9 and year(date) = 1997) where rn = 1""",
)
def version_pick(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    version = F.when(k % 3 == 0, "v001").otherwise("v002")
    url = F.concat(F.lit("https://archive.example/"), F.year(day), F.lit("/LAND_"), version, F.lit("_"), F.date_format(day, "yyyyMMdd"), F.lit("_c"), k, F.lit(".nc"))
    links = _orders(spark, sf_dir).select(version.alias("version"), url.alias("url"))
    return pick_version(prune_by_date(links, year=1997, months=(6, 9)))


_BLANKS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@register(
    "preamble_scan",
    "doc_id:l n_tokens:l digest:s",
    f"""with t as (select doc_id, list_filter(string_split_regex(text, '{_BLANKS}'), lambda x: x <> '') as toks from documents),
    p as (select doc_id, toks, list_position(list_transform(toks, lambda x: starts_with(x, 'the')), true) as first from t),
    k as (select doc_id, list_slice(toks, first, len(toks)) as kept from p where first > 0),
    d as (select doc_id, flatten(list_transform(kept, lambda x, i: case when starts_with(x, 'the') and i > 1 then [x, x] else [x] end)) as out from k)
    select doc_id, len(out) as n_tokens, md5(array_to_string(out, chr(10))) as digest from d""",
)
def preamble_scan(spark, sf_dir):
    """Whole texts below their first line marker."""
    body = F.explode(F.array_compact(F.array(body_lines(F.col("text"), "the"))))
    read = table(spark, sf_dir, "documents").select("doc_id", body.alias("lines"))
    return read.select("doc_id", F.size(F.split("lines", "\n")).alias("n_tokens"), F.md5("lines").alias("digest"))


@register(
    "file_factor",
    "factor:s LAT:f6 LON:f6 DATE:d value:f6",
    f"select event_type as factor, lat as LAT, lon as LON, cast(ts as date) as DATE, value from (select *, {place_sql('user_id')} from events)",
)
def file_factor(spark, sf_dir):
    """Readings named by file: the factor is the text before the first underscore."""
    spot = place("user_id")
    files = table(spark, sf_dir, "events").select(
        F.concat(F.col("event_type"), F.lit("_"), F.date_format("ts", "yyyyMM"), F.lit("_tile1.csv")).alias("file"),
        spot["lat"].alias("LAT"), spot["lon"].alias("LON"), F.year("ts").alias("YEAR"), F.dayofyear("ts").alias("DOY"), "value",
    )
    return files.select(factor_of(F.col("file")).alias("factor"), "LAT", "LON", day_of_year_to_date(F.col("YEAR"), F.col("DOY")).alias("DATE"), "value")


@register(
    "partition_manifest",
    "variable:s month_start:d month_end:d tile:s",
    """with lim as (select date_trunc('month', min(o_orderdate)) as a, date_trunc('month', max(o_orderdate)) as b from orders),
    m as (select cast(unnest(generate_series(a, b, interval 1 month)) as date) as month_start from lim),
    want as (select v.variable, m.month_start, t.tile from (select distinct o_orderpriority as variable from orders) v cross join m cross join (values ('tile1'), ('tile2'), ('tile3')) t(tile) where month(month_start) between 6 and 9),
    have as (select distinct o_orderpriority as variable, cast(date_trunc('month', o_orderdate) as date) as month_start, 'tile' || (1 + o_orderkey % 2) as tile from orders)
    select w.variable, w.month_start, last_day(w.month_start) as month_end, w.tile from want w where not exists (select 1 from have h where h.variable = w.variable and h.month_start = w.month_start and h.tile = w.tile)""",
)
def partition_manifest_query(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    first, last = orders.agg(F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date")).first()
    variables = orders.select(F.col("o_orderpriority").alias("variable")).distinct()
    landed = orders.select(
        F.col("o_orderpriority").alias("variable"), F.trunc("o_orderdate", "month").alias("month_start"), F.concat(F.lit("tile"), F.col("o_orderkey") % 2 + 1).alias("tile")
    )
    return partition_manifest(variables, ["tile1", "tile2", "tile3"], [6, 7, 8, 9], landed, first=F.lit(first), last=F.lit(last))


@register(
    "set_ops",
    "op:s n:l total:l",
    """with a as (select c_custkey as k from customer), b as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), n as (select s_suppkey as k from supplier)
    select 'union_all' as op, count(*) as n, sum(k) as total from (select k from a union all select k from n) union all select 'union_distinct', count(*), sum(k) from (select k from a union select k from n)
    union all select 'intersect', count(*), sum(k) from (select k from a intersect select k from b) union all select 'except', count(*), sum(k) from (select k from a except select k from b)""",
)
def set_ops(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    b = _orders(spark, sf_dir).where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    n = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    results = {"union_all": a.unionByName(n), "union_distinct": a.unionByName(n).distinct(), "intersect": a.intersect(b), "except": a.join(b, "k", "left_anti").distinct()}
    rows = [d.agg(F.count("*").alias("n"), F.sum("k").alias("total")).select(F.lit(op).alias("op"), "n", "total") for op, d in results.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
