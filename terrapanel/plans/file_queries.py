"""Sources and sinks by round trips: the given tables are written as files, read again, and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrapanel.operators import qa
from terrapanel.plans import roles
from terrapanel.plans.catalog import register
from terrapanel.plans.roles import place, place_sql, table
from terrapanel.session import ensure_checkpoint_dir
from terrapanel.sources import sinks, tabular
from terrapanel.sources.boundaries import read_boundary
from terrapanel.sources.settings import read_settings


def _folder(spark) -> str:
    """A new folder where all executors can write and read."""
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _priced_orders(spark, sf_dir):
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"), F.col("o_orderdate").cast("date").alias("day"))


_PRICED = "select o_orderkey, case when o_orderstatus <> 'P' then o_totalprice end as price, cast(o_orderdate as date) as day from orders"


@register("csv_round_trip", "o_orderkey:l price:f2 day:d", _PRICED)
def csv_round_trip(spark, sf_dir):
    """CSV with a header, NaN for missing and American dates, read under a declared schema with that format."""
    path = _folder(spark)
    sinks.write_csv(_priced_orders(spark, sf_dir).withColumn("day", F.date_format("day", "MM/dd/yyyy")), path, missing="NaN", order=["day", "o_orderkey"])
    return tabular.scan_csv(spark, path, "o_orderkey long, price double, day date", required=["day"], date_format="MM/dd/yyyy")


@register(
    "table_round_trip",
    "kind:s o_orderkey:l price:f2 day:d",
    f"select 'parquet' as kind, o_orderkey, cast(cast(price as real) as double) as price, day from ({_PRICED}) union all select 'csv', o_orderkey, cast(cast(price as real) as double), day from ({_PRICED})",
)
def table_round_trip(spark, sf_dir):
    """The same table as Parquet with floats, and as CSV where the path says so."""
    folder, orders = _folder(spark), _priced_orders(spark, sf_dir)
    sinks.write_table(orders, f"{folder}/whole", small=True)
    sinks.write_table(orders, f"{folder}/whole.csv", small=True)
    parquet = spark.read.parquet(f"{folder}/whole")
    text = tabular.scan_csv(spark, f"{folder}/whole.csv", "o_orderkey long, price float, day date")
    return parquet.select(F.lit("parquet").alias("kind"), "*").unionByName(text.select(F.lit("csv").alias("kind"), "*"))


@register("files_by_year", "o_orderkey:l price:f2 day:d year:l", f"select *, year(day) as year from ({_PRICED})")
def files_by_year(spark, sf_dir):
    """One folder a year, read together, each row with the year of the folder that holds it."""
    path = _folder(spark)
    sinks.write_by_year(_priced_orders(spark, sf_dir), path, "day")
    return spark.read.parquet(path)


@register("files_by_day", "o_orderkey:l price:f2 day:d", _PRICED)
def files_by_day(spark, sf_dir):
    path = _folder(spark)
    sinks.write_by_day(_priced_orders(spark, sf_dir), path, "day")
    return spark.read.parquet(path)


@register("parquet_as_csv", "p_partkey:l p_name:s p_size:l p_retailprice:f2", "select p_partkey, p_name, p_size, p_retailprice from part")
def parquet_as_csv(spark, sf_dir):
    """Parquet files turned into CSV files."""
    path = _folder(spark)
    tabular.parquet_to_csv(spark, f"{sf_dir}/part.parquet", path)
    text = spark.read.option("header", True).csv(path)
    return text.select(F.col("p_partkey").cast("long"), "p_name", F.col("p_size").cast("long"), F.col("p_retailprice").cast("double"))


@register("files_by_pattern", "p_partkey:l p_size:l", "select p_partkey, p_size from part where p_size between 10 and 39")
def files_by_pattern(spark, sf_dir):
    """Files whose names match a pattern with wildcards, as one table under renamed columns."""
    path = _folder(spark)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("KEY"), F.col("p_size").alias("SIZE"), F.lpad(F.col("p_size").cast("string"), 2, "0").alias("s"))
    parts.write.partitionBy("s").option("header", True).csv(path)
    return tabular.scan_csv(spark, f"{path}/s=[123]?", "KEY long, SIZE int", aliases={"p_partkey": ["key", "KEY"], "p_size": ["SIZE"]}, required=["p_size"])


@register(
    "aligned_by_position",
    "position:l o_totalprice:f2 o_orderstatus:s o_orderpriority:s",
    "select row_number() over (order by o_orderkey) - 1 as position, o_totalprice, o_orderstatus, o_orderpriority from orders",
)
def aligned_by_position(spark, sf_dir):
    """Features and labels in files of their own without a key, cut differently, side by side in file order."""
    folder, orders = _folder(spark), table(spark, sf_dir, "orders")
    for name, columns, parts in (("x", ["o_totalprice", "o_orderstatus"], 3), ("y", ["o_orderpriority"], 5)):
        ordered = orders.repartitionByRange(parts, "o_orderkey").sortWithinPartitions("o_orderkey")
        ordered.select(*columns).write.option("header", True).csv(f"{folder}/{name}")
    features = spark.read.schema("o_totalprice double, o_orderstatus string").option("header", True).csv(f"{folder}/x")
    labels = spark.read.schema("o_orderpriority string").option("header", True).csv(f"{folder}/y")
    return tabular.align_by_position(features, labels)


@register(
    "report_files",
    "name:s rows:l missing:l",
    f"with p as ({_PRICED}) select 'summary price' as name, count(*) as rows, count(*) - count(price) as missing from p union all select 'late', count(*), 0 from p where day >= date '1998-01-01' having count(*) > 0",
)
def report_files(spark, sf_dir):
    """A summary and the violations of those checks that found any, written and read again."""
    folder, orders = _folder(spark), _priced_orders(spark, sf_dir)
    late, never = orders.where("day >= date '1998-01-01'"), orders.where("day < date '1900-01-01'")
    found = sinks.write_report(qa.null_fraction(orders, ["price"]), {"late": late, "never": never}, folder)
    summary = spark.read.option("header", True).csv(f"{folder}/summary").select(F.concat(F.lit("summary "), "name").alias("name"), F.col("rows").cast("long"), F.col("missing").cast("long"))
    for name in found:
        rows = spark.read.option("header", True).csv(f"{folder}/{name}").agg(F.count("*").alias("rows"))
        summary = summary.unionByName(rows.select(F.lit(name).alias("name"), "rows", F.lit(0).cast("long").alias("missing")))
    return summary


@register(
    "settings_file",
    "start_date:s end_date:s x0:f6 y0:f6 x1:f6 y1:f6 resolution_km:f1",
    f"with {roles.CELLS} select (select cast(cast(min(ts) as date) as varchar) from events) as start_date, (select cast(cast(max(ts) as date) as varchar) from events) as end_date, min(lon) as x0, min(lat) as y0, max(lon) as x1, max(lat) as y1, 5 as resolution_km from cells",
)
def settings_file(spark, sf_dir):
    """A settings document of the cells' extent and the readings' period, written as JSON and read as settings."""
    path, (first, last) = _folder(spark), roles.calendar_span(spark, sf_dir)
    extent = roles.cells(spark, sf_dir).agg(F.min("lon").alias("min_longitude"), F.max("lon").alias("max_longitude"), F.min("lat").alias("min_latitude"), F.max("lat").alias("max_latitude"))
    period = F.struct(F.lit(str(first)).alias("start_date"), F.lit(str(last)).alias("end_date"))
    extent.select(period.alias("time_period"), F.struct("*").alias("spatial_extent"), F.struct(F.lit(5.0).alias("resolution_km")).alias("grid")).coalesce(1).write.json(path)
    read = read_settings(spark, path)
    return spark.createDataFrame([(read.start_date, read.end_date, *read.bbox, read.resolution_km)], "start_date string, end_date string, x0 double, y0 double, x1 double, y1 double, resolution_km double")


@register(
    "boundary_file",
    "x0:f6 y0:f6 x1:f6 y1:f6 hole:b",
    f"""with spots as (select s_suppkey, {place_sql('s_suppkey')} from supplier where s_nationkey % 5 = 2)
    select lon as x0, lat as y0, lon + 0.5e0 as x1, lat + 0.5e0 as y1, false as hole from spots union all
    select lon + 0.1e0, lat + 0.1e0, lon + 0.2e0, lat + 0.2e0, true from spots where s_suppkey % 2 = 0""",
)
def boundary_file(spark, sf_dir):
    """Boundary documents, one a nation, read as files; the features that match the first property any has."""
    path, spot = _folder(spark), place("s_suppkey")
    placed = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", spot["lon"].alias("x"), spot["lat"].alias("y"))

    def ring(low: float, high: float):
        return F.array(*[F.array(F.col("x") + a, F.col("y") + b) for a, b in ((low, low), (high, low), (high, high), (low, high), (low, low))])

    rings = F.when(F.col("s_suppkey") % 2 == 0, F.array(ring(0.0, 0.5), ring(0.1, 0.2))).otherwise(F.array(ring(0.0, 0.5)))
    shape = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('"MultiPolygon","coordinates":'), F.to_json(F.array(rings)))).otherwise(F.concat(F.lit('"Polygon","coordinates":'), F.to_json(rings)))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"STATEFP":"'), F.col("s_nationkey") % 5, F.lit('"},"geometry":{"type":'), shape, F.lit("}}"))
    documents = placed.groupBy("s_nationkey").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("value"))
    documents.repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    found = read_boundary(spark, path, [("STUSPS", "CA"), ("STATEFP", "2")])
    xs, ys = F.transform("ring", lambda v: v["x"]), F.transform("ring", lambda v: v["y"])
    return found.select(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"), "hole")


@register("sorted_head", "place:l o_orderkey:l price:f2", f"select row_number() over (order by price desc nulls last, o_orderkey) as place, o_orderkey, price from ({_PRICED}) order by place limit 100")
def sorted_head(spark, sf_dir):
    """The first hundred rows of a written table, sorted by two keys."""
    path = _folder(spark)
    sinks.write_csv(_priced_orders(spark, sf_dir), path, order=["o_orderkey"])
    read = tabular.scan_csv(spark, path, "o_orderkey long, price double, day date")
    order = [F.col("price").desc_nulls_last(), F.col("o_orderkey")]
    head = read.orderBy(*order).limit(100)  # the report's length
    return head.withColumn("place", F.row_number().over(Window.orderBy(*order)))
