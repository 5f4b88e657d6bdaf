"""URL filters: nested prefix rules as intervals of reversed-host keys, met by a sort-merge range join.

A rule (host, path) fits its host and all subdomains where the path starts with
the rule's path.  Host and path are two prefixes, so one interval can't hold
both; a URL is therefore looked up once for each suffix of its host that some
rule names, under the key ``reversed suffix + path``.  There, a rule is the
interval of all keys that start with its own.  Prefix intervals nest or are
disjoint, so that a sorted sweep needs only the innermost open rule: the stack's
top.  Its changes (rule opens, rule closes and its parent is back on top) are the
boundary rows that keys and rules are merged with, by sort, in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrapanel.llm.common import send_if_small
from terrapanel.session import cut_lineage, shuffle_width

# Keys a sweep task is meant to hold at most; fewer where there are too few for all task slots.
SWEEP_ROWS = 500_000


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; both empty for NULL and for URLs without ``://``."""
    rest = F.when(F.locate("://", F.col(url)) > 0, F.expr(f"substr(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", low).withColumn("path", path)


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def compile_rules(rules: DataFrame) -> DataFrame:
    """Boundary rows (key, rule, verdict) of a table (rule, verdict), where a rule is ``host/path``.

    From ``key`` on, up to the next boundary, ``rule`` is the innermost open one
    (NULL: none).  Keys are binary, so that a closing key sorts after every key
    that starts with the rule's.  Of rules stated twice the blocking one counts.
    """
    host, path = F.regexp_extract("rule", r"^([^/]*)", 1), F.regexp_extract("rule", r"^[^/]*(.*)$", 1)
    own = rules.where(F.col("rule").isNotNull()).groupBy("rule").agg(F.max("verdict").alias("verdict"))
    own = cut_lineage(own.select("rule", "verdict", F.lower(host).alias("host"), F.concat(_reversed(F.lower(host)), path).alias("text")))
    prefixes = own.select(F.col("text").alias("child"), F.explode(F.expr("transform(sequence(0, length(text) - 1), i -> substr(text, 1, i))")).alias("text"))
    parents = prefixes.join(own.select("text", "rule", "verdict"), "text").groupBy("child").agg(
        F.max_by(F.struct("rule", "verdict"), F.length("text")).alias("up")
    )
    closing = own.join(parents, own["text"] == parents["child"], "left")
    opens = own.select(F.col("text").cast("binary").alias("key"), "rule", "verdict", F.length("text").alias("depth"))
    closes = closing.select(
        F.concat(own["text"].cast("binary"), F.lit(b"\xff")).alias("key"), F.col("up.rule").alias("rule"), F.col("up.verdict").alias("verdict"), (-F.length(own["text"])).alias("depth")
    )
    # Of intervals that end at one key the outermost closes last.
    both = opens.unionByName(closes).groupBy("key").agg(F.max_by(F.struct("rule", "verdict"), "depth").alias("top"))
    return both.select("key", "top.rule", "top.verdict")


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    The longest fitting rule wins; of rules of one length, the one of the longer
    host.  Rows no rule fits, NULL urls included, have rule NULL and the default
    verdict.  Repeated rows are judged alike and all returned.  An empty rule table
    judges everything by default.
    """
    spark = pages.sparkSession
    split = split_url(pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url")), "_url")
    bounds = cut_lineage(compile_rules(rules))
    hosts = rules.select(F.lower(F.regexp_extract("rule", r"^([^/]*)", 1)).alias("suffix")).distinct()

    # One key for each suffix of the host that has rules of its own.
    labels = F.split("host", r"\.", -1)
    levels = F.transform(F.sequence(F.lit(1), F.size("_l")), lambda i: F.array_join(F.slice("_l", i, F.size("_l")), "."))
    places = split.select("host", "path").distinct().withColumn("_l", labels).select("host", "path", F.explode(levels).alias("suffix"))
    hosts = send_if_small(cut_lineage(hosts), F.lit(32) + F.length("suffix"))
    places = places.join(hosts, "suffix", "left_semi")
    keys = cut_lineage(places.select("host", "path", F.concat(_reversed(F.col("suffix")), F.col("path")).cast("binary").alias("key")))

    top = _sweep(keys, bounds, shuffle_width(spark))
    best = top.where(F.col("rule").isNotNull()).groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.instr("rule", "/"))).alias("won"))
    judged = split.join(best, ["host", "path"], "left")
    return judged.select(F.col("_id").alias(page_id), "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def _sweep(keys: DataFrame, bounds: DataFrame, width: int) -> DataFrame:
    """Every key row with the boundary row it falls behind: an as-of merge by sort.

    The key space is cut at evenly spaced boundaries into as many ranges as the
    cluster is wide; a range with many keys is swept in several slices, each with
    the range's boundaries, so that a busy host is not one task.
    """
    ranked = cut_lineage(bounds.repartitionByRange(width, "key").select("key", "rule", "verdict", (F.spark_partition_id() + 1).alias("_range")))
    # One key for each range, of which there are ``width`` at most.
    starts = sorted((bytes(r["_from"]), r["_range"]) for r in ranked.groupBy("_range").agg(F.min("key").alias("_from")).collect())
    if not starts:
        return keys.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    start_keys = F.array(*[F.lit(key) for key, _ in starts])
    ranges = F.array(*[F.lit(number) for _, number in starts])
    behind = F.size(F.filter(start_keys, lambda s: s <= F.col("key")))
    placed = keys.select("host", "path", "key", F.when(behind > 0, F.element_at(ranges, behind)).otherwise(F.lit(0)).alias("_range"))
    placed = placed.where(F.col("_range") > 0)
    counts = cut_lineage(placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")))  # one row for each range, of which there are ``width``
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    each = max(1, min(SWEEP_ROWS, -(-total // width)))
    counts = F.broadcast(counts.select("_range", F.ceil(F.col("_n") / each).cast("int").alias("_slices")))
    sliced = placed.join(counts, "_range").select("host", "path", "key", "_range", F.pmod(F.xxhash64("host", "path"), F.col("_slices")).cast("int").alias("_slice"))
    spread = ranked.join(counts, "_range").select("key", "rule", "verdict", "_range", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"))
    events = spread.select("*", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("_kind")).unionByName(
        sliced.select("key", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), "_range", "_slice", "host", "path", F.lit(1).alias("_kind"))
    )
    order = Window.partitionBy("_range", "_slice").orderBy("key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("_kind") == 0, F.struct("rule", "verdict")), ignorenulls=True).over(order)
    return events.withColumn("_top", top).where(F.col("_kind") == 1).select("host", "path", "_top.rule", "_top.verdict")


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs as a table."""
    return spark.createDataFrame(rules, "verdict string, rule string")
