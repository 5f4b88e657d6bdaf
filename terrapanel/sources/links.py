"""Index pages, file choice and expected-file manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The address attribute of an anchor, quoted or not, in any case.
HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def anchor_links(html: Column) -> Column:
    """Array of the addresses that the anchors of a page name."""
    quoted = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    return F.transform(quoted, lambda q: F.regexp_replace(F.regexp_replace(q, "^[\"']|[\"']$", ""), "(?i)&amp;", "&"))


def index_url(page: Column, link: Column) -> Column:
    """``link`` appended to the address of its index page, whatever that ends in; links that start with http stay."""
    return F.when(link.startswith("http"), link).otherwise(F.concat(F.rtrim(page, F.lit("/")), F.lit("/"), F.ltrim(link, F.lit("/"))))


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments carried out (RFC 3986, 5.2.4)."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)
    none = F.array().cast("array<string>")

    def step(done: Column, segment: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(segment == ".", done).when(segment == "..", up).otherwise(F.concat(done, F.array(segment)))

    kept = F.aggregate(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), none, step)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def absolute_url(page: Column, link: Column) -> Column:
    """``link`` resolved against the address of its page by RFC 3986."""
    scheme = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    root = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page_path = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    page_query = F.regexp_extract(page, r"^[^?#]*(\?[^#]*)", 1)
    link_path, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    folder = F.when(page_path == "", F.lit("/")).otherwise(F.regexp_replace(page_path, r"[^/]*$", ""))
    path = F.when(link_path.startswith("/"), link_path).otherwise(F.concat(folder, link_path))
    same = F.when(rest.startswith("?"), F.concat(root, page_path, rest)).otherwise(F.concat(root, page_path, page_query, rest))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link_path == "", same)
        .otherwise(F.concat(root, _without_dots(path), rest))
    )


def harvest_links(pages: DataFrame, suffix: str = ".nc", *, url: str = "url", html: str = "html", resolve=index_url) -> DataFrame:
    """Distinct addresses of the links whose address ends in ``suffix`` in any case.

    ``resolve`` is ``index_url``, which appends to the index page's address, or
    ``absolute_url``, which follows the standard.
    """
    found = pages.select(F.col(url).alias("_page"), F.explode(anchor_links(F.col(html))).alias("_link"))
    wanted = found.where(F.lower("_link").endswith(suffix.lower())) if suffix else found
    return wanted.select(resolve(F.col("_page"), F.col("_link")).alias("url")).distinct()


def link_date(url: Column) -> Column:
    return F.try_to_date(F.regexp_extract(url, r"_(\d{8})_", 1), "yyyyMMdd")


def prune_by_date(links: DataFrame, *, start: str | None = None, end: str | None = None, year: int | None = None, months: tuple[int, int] | None = None) -> DataFrame:
    """Links whose name carries a date inside the range, or of a year and month span; distinct."""
    day = link_date(F.col("url"))
    test = day.isNotNull()
    if start:
        test = test & (day >= F.lit(start).cast("date"))
    if end:
        test = test & (day <= F.lit(end).cast("date"))
    if year:
        test = test & (F.year(day) == year)
    if months:
        test = test & F.month(day).between(*months)
    return links.withColumn("date", day).where(test).distinct()


def pick_version(links: DataFrame, prefer: str = "v001", *, keys: Sequence[str] = ("date",), version: str = "version", url: str = "url") -> DataFrame:
    """One link per key: the preferred version if there is one, then the first address."""
    rest = [c for c in links.columns if c not in (*keys, url)]
    best = F.min(F.struct((F.col(version) != prefer).alias("_other"), F.col(url), *rest)).alias("_row")
    return links.groupBy(*keys).agg(best).select(*keys, "_row.*").drop("_other").select(*links.columns)


def month_windows(first: Column, last: Column) -> Column:
    """First days of the months from ``first`` to ``last``."""
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))


def partition_manifest(variables: DataFrame, tiles: Sequence[str], months: Sequence[int] | None, landed: DataFrame, *, first: Column, last: Column) -> DataFrame:
    """Files that should exist and do not: variable x month x tile minus ``landed`` (variable, month_start, tile).

    Requests are generated inside each variable's row.
    """
    wanted = variables.select("variable", F.explode(month_windows(first, last)).alias("month_start"))
    if months:
        wanted = wanted.where(F.month("month_start").isin(list(months)))
    wanted = wanted.select("variable", "month_start", F.last_day("month_start").alias("month_end"), F.explode(F.array(*[F.lit(t) for t in tiles])).alias("tile"))
    return wanted.join(landed.select("variable", "month_start", "tile").distinct(), ["variable", "month_start", "tile"], "left_anti")
