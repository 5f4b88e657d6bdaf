"""Parsing sources over text that is made from the given tables, and audits of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.functions.columns import class_column_names
from terrapanel.functions.geo import albers_forward
from terrapanel.operators import qa
from terrapanel.operators.cleaning import coerce_numeric, missing_columns, normalise_headers, require_columns
from terrapanel.operators.landcover import landcover_fraction
from terrapanel.operators.panel import align_labels, feature_columns
from terrapanel.plans import roles
from terrapanel.plans.catalog import register
from terrapanel.plans.panel_queries import _FLAWED, _flawed
from terrapanel.plans.roles import place, place_sql, table
from terrapanel.sources.boundaries import dissolve
from terrapanel.sources.incidents import features_of
from terrapanel.sources.tabular import elevation_rows
from terrapanel.sources.tiles import window_read


@register("feature_rows", "IrwinID:s FireDiscoveryDateTime:l POOState:s", "select 'I' || o_orderkey as IrwinID, epoch_ms(o_orderdate) as FireDiscoveryDateTime, o_orderstatus as POOState from orders")
def feature_rows(spark, sf_dir):
    """Incident features out of JSON pages of at most a hundred."""
    stamp = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    properties = F.struct(F.concat(F.lit("I"), F.col("o_orderkey")).alias("IrwinID"), stamp.alias("FireDiscoveryDateTime"), F.col("o_orderstatus").alias("POOState"))
    one = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"))
    paged = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 100).alias("page")).agg(F.collect_list(one).alias("features"))
    pages = paged.select(F.to_json(F.struct("features")).alias("text"))
    return features_of(pages, "text", "IrwinID string, FireDiscoveryDateTime bigint, POOState string")


@register(
    "boundary_dissolve",
    "x0:f6 y0:f6 x1:f6 y1:f6 hole:b",
    f"""with spots as (select s_suppkey, {place_sql('s_suppkey')} from supplier where s_nationkey % 5 = 2)
    select lon as x0, lat as y0, lon + 0.5e0 as x1, lat + 0.5e0 as y1, false as hole from spots union all
    select lon + 0.1e0, lat + 0.1e0, lon + 0.2e0, lat + 0.2e0, true from spots where s_suppkey % 2 = 0""",
)
def boundary_dissolve(spark, sf_dir):
    """Rings of the features that match the first property any feature has; every second feature has a hole."""
    spot = place("s_suppkey")
    placed = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", spot["lon"].alias("x"), spot["lat"].alias("y"))

    def ring(low: float, high: float):
        corners = [(low, low), (high, low), (high, high), (low, high), (low, low)]
        return F.array(*[F.array(F.col("x") + a, F.col("y") + b) for a, b in corners])

    rings = F.when(F.col("s_suppkey") % 2 == 0, F.array(ring(0.0, 0.5), ring(0.1, 0.2))).otherwise(F.array(ring(0.0, 0.5)))
    multi = F.col("s_suppkey") % 3 == 0
    shaped = placed.select(
        F.create_map(F.lit("STATEFP"), (F.col("s_nationkey") % 5).cast("string")).alias("properties"),
        F.when(multi, "MultiPolygon").otherwise("Polygon").alias("type"),
        F.when(multi, F.to_json(F.array(rings))).otherwise(F.to_json(rings)).alias("coordinates"),
    )
    found = dissolve(shaped, [("STUSPS", "CA"), ("STATEFP", "2")])
    xs, ys = F.transform("ring", lambda v: v["x"]), F.transform("ring", lambda v: v["y"])
    return found.select(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"), "hole")


@register(
    "units_row",
    "longitude:f6 latitude:f6 elev:f6",
    f"""select lon as longitude, lat as latitude, case when p_partkey % 11 <> 0 then p_partkey + 0.5e0 end as elev from (select p_partkey, {place_sql('p_partkey')} from part) where p_partkey % 50 <> 0""",
)
def units_row(spark, sf_dir):
    """Elevation text with trimmed headers, rows of units, and numbers with commas and units."""
    k, spot = F.col("p_partkey"), place("p_partkey")
    unit = k % 50 == 0
    text = table(spark, sf_dir, "part").select(
        F.when(unit, "degrees_east").otherwise(spot["lon"].cast("string")).alias(" Longitude "),
        F.when(unit, "degrees_north").otherwise(spot["lat"].cast("string")).alias("LATITUDE"),
        F.when(unit, "m").when(k % 11 == 0, "n/a").otherwise(F.concat(F.format_number(k, 0), F.lit(".5 m"))).alias("Elev"),
    )
    return elevation_rows(text)


_CODES = {"ECONOMY": 11, "LARGE": 22, "MEDIUM": 42, "PROMO": 52, "SMALL": 82, "STANDARD": 90}


@register(
    "class_columns",
    "cell:l pct_Open_Water:f6 pct_Evergreen_Forest:f6",
    "select p_partkey // 40 as cell, 100e0 * count(*) filter (where p_type = 'ECONOMY') / count(*) as pct_Open_Water, 100e0 * count(*) filter (where p_type = 'MEDIUM') / count(*) as pct_Evergreen_Forest from part group by 1",
)
def class_columns(spark, sf_dir):
    """Shares by class code, renamed to the classes' names."""
    code = F.coalesce(*[F.when(F.col("p_type") == name, number) for name, number in _CODES.items()])
    pixels = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 40).alias("cell"), code.alias("code"))
    return landcover_fraction(pixels, ["cell"], "code", list(_CODES.values())).withColumnsRenamed(class_column_names())


@register(
    "header_normalise",
    "c_custkey:l c_acctbal:f6",
    "select c_custkey, case when c_custkey % 7 <> 0 then c_acctbal end as c_acctbal from customer",
)
def header_normalise(spark, sf_dir):
    """Trimmed lower-case headers; text that is no number becomes NULL."""
    raw = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(" C_CUSTKEY"), F.when(F.col("c_custkey") % 7 == 0, "unknown").otherwise(F.col("c_acctbal").cast("string")).alias("C_AcctBal ")
    )
    named = require_columns(normalise_headers(raw), ["c_custkey", "c_acctbal"])
    return coerce_numeric(named, ["c_acctbal"])


@register(
    "aligned_features",
    "doc_id:l n_chars:l pct_a:f6 toxic:l",
    "select d.doc_id, n_chars, n_chars / 100e0 as pct_a, toxic from documents d join labels l on l.doc_id = d.doc_id",
)
def aligned_features(spark, sf_dir):
    """Features and labels of two tables met by key, with the features a training frame keeps."""
    wide = table(spark, sf_dir, "documents").withColumn("pct_a", F.col("n_chars") / 100.0)
    kept = feature_columns(wide, ["n_chars"], optional=["score"], prefixes=["pct_"], drop=["text"])
    return align_labels(wide.select("doc_id", *kept), table(spark, sf_dir, "labels").select("doc_id", "toxic"), ["doc_id"])


@register(
    "raster_window",
    "id:l x:f3 y:f3",
    f"with {roles.POINTS}, {roles.cone_sql('EPSG:3310')}, xy as ({roles.forward_sql('points')}) select id, x, y from xy where x between -400000 and -330000 and y between -600000 and -450000",
)
def raster_window(spark, sf_dir):
    """Pixels of a projected window."""
    x, y = albers_forward("lon", "lat", "EPSG:3310")
    return window_read(roles.points(spark, sf_dir).select("id", x.alias("x"), y.alias("y")), (-400000.0, -600000.0, -330000.0, -450000.0))


@register(
    "qa_report",
    "section:s metric:s value:s",
    f"""with {_FLAWED}, inc as (select cast(o_orderdate as date) as date, o_orderstatus as state from orders),
    days as (select date_diff('day', date '1996-01-01', date '1999-12-31') + 1 as n)
    select 'shape' as section, 'lookup_cells' as metric, cast(count(distinct grid_id) as varchar) as value from lookup union all select 'shape', 'label_rows', cast(count(*) as varchar) from raw
    union all select 'shape', 'expected_rows', cast((select count(distinct grid_id) from lookup) * n as varchar) from days union all select 'columns', 'missing', ''
    union all select 'positives', 'positives', cast(sum(cast(fire_today = 1 as integer)) as varchar) from raw
    union all select 'incidents', 'rows', cast(count(*) as varchar) from inc union all select 'incidents', 'date_min', cast(min(date) as varchar) from inc union all select 'incidents', 'date_max', cast(max(date) as varchar) from inc
    union all select 'state_counts', state, cast(count(*) as varchar) from inc group by state
    union all select 'violations', 'bad_dates', cast(count(*) as varchar) from raw where try_cast(date as date) is null or try_cast(date as date) not between date '1996-01-01' and date '1999-12-31'
    union all select 'violations', 'bad_values', cast(count(*) as varchar) from raw where fire_today not in (0, 1)
    union all select 'violations', 'missing_grid_ids', cast(count(*) as varchar) from raw where grid_id not in (select grid_id from lookup)
    union all select 'violations', 'labels_not_in_events', cast(count(*) as varchar) from (select distinct date, grid_id from raw where fire_today = 1 except select date, grid_id from ev)
    union all select 'columns', 'extra', 'fire_tomorrow'""",
)
def qa_report_query(spark, sf_dir):
    """The report's counts, and a column that is asked for in vain."""
    labels, lookup, events = _flawed(spark, sf_dir)
    incidents = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderstatus").alias("state"))
    report, _ = qa.qa_report(labels, lookup, incidents, "1996-01-01", "1999-12-31", events)
    lacking = ",".join(missing_columns(labels, ["date", "grid_id", "fire_tomorrow"]))
    extra = labels.limit(1).select(F.lit("columns").alias("section"), F.lit("extra").alias("metric"), F.lit(lacking).alias("value"))
    return report.where("metric <> 'pos_rate'").unionByName(extra)
