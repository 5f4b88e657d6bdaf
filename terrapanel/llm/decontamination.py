"""Benchmark decontamination: broadcast hash set of test n-grams, scan of training windows, exact check, removal.

What every executor gets are the windows' keys alone, eight bytes each, as many at a
time as the limit allows; a larger benchmark takes several scans of the documents.  So
documents are never shuffled, only the places whose key is a window's; there the words
themselves are compared.

Words are what ``common.words`` takes.  A window is ``size`` consecutive words of
an item; an item of fewer words, but not none, is one window.  All built-in
expressions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import send_if_small, words
from terrapanel.session import cut_lineage

WINDOW = 10
# Bytes of keys sent to every executor at a time, and of one key in a hash table.
KEY_BYTES, BYTES_OF_KEY = 64 << 20, 32
# The separators as they stand in the original text.
_BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def _longs() -> Column:
    return F.array().cast("array<bigint>")


def _with_window_keys(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Add ``_k<L>``: the keys of all windows of L words, by position, for each L.

    Keys of 2, 4 and 8 words come from two keys of half the length, any other
    length from those, so that the work per word doesn't depend on the length.
    """
    df = df.withColumn("_n", F.size("_words")).withColumn("_w1", F.transform("_words", lambda w: F.xxhash64(w)))

    def paired(x: str, y: str, shift: int) -> Column:
        later = F.when(F.col("_n") > shift, F.slice(y, F.lit(shift + 1), F.greatest(F.col("_n"), F.lit(1)))).otherwise(_longs())
        return F.zip_with(x, later, lambda a, b: F.xxhash64(a, b))

    width = 1
    while width * 2 <= max(lengths, default=1):
        df = df.withColumn(f"_w{width * 2}", paired(f"_w{width}", f"_w{width}", width))
        width *= 2
    for length in lengths:
        name, done = None, 0
        for power in (1 << i for i in reversed(range(length.bit_length()))):
            if not length & power:
                continue
            if name is None:
                name, done = f"_w{power}", power
            else:
                df = df.withColumn(f"_p{length}_{done}", paired(name, f"_w{power}", done))
                name, done = f"_p{length}_{done}", done + power
        whole = F.when(F.col("_n") >= length, F.slice(name, F.lit(1), F.greatest(F.col("_n") - (length - 1), F.lit(1)))).otherwise(_longs())
        df = df.withColumn(f"_k{length}", whole)
    return df


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> tuple[DataFrame, list[int]]:
    """(key, length, window, items): the distinct windows of the items, and the lengths that occur (``size`` of them at most)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("_words")).where(F.size("_words") > 0)
    lengths = [r["n"] for r in items.select(F.least(F.size("_words"), F.lit(size)).alias("n")).distinct().orderBy("n").collect()]
    parts = []
    for n in lengths:
        own = F.size("_words") == n if n < size else F.size("_words") >= size
        keyed = _with_window_keys(items.where(own), [n]).select("item", "_words", F.posexplode(f"_k{n}").alias("at", "key"))
        parts.append(keyed.select("key", F.lit(n).alias("length"), F.slice("_words", F.col("at") + 1, F.lit(n)).alias("window"), "item"))
    if not parts:
        schema = "key bigint, length int, window array<string>, items array<string>"
        return benchmark.sparkSession.createDataFrame([], schema), []
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return cut_lineage(table.groupBy("key", "length", "window").agg(F.collect_set("item").alias("items"))), lengths


def identity(doc_id: str, text: str) -> list[Column]:
    """Two independent hashes that stand for a row of the input; equal rows share them."""
    return [F.xxhash64(F.col(doc_id), F.col(text)).alias("_ka"), F.xxhash64(F.lit(1), F.col(text), F.col(doc_id)).alias("_kb")]


def _candidates(rows: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(ka, kb, at, length, key, words): the places of documents whose key and length are a window's.

    The keys are dealt to as many slices as their counted bytes need; each slice is
    broadcast and meets all documents.
    """
    keys = windows.select("key", "length").distinct()
    slices = max(1, -(-windows.count() * BYTES_OF_KEY // KEY_BYTES))
    start, length, before = F.lit(None).cast("int"), F.lit(0), F.lit(0)
    for n in lengths:
        count = F.greatest(F.col("_n") - (n - 1), F.lit(0))
        inside = (F.col("_p") >= before) & (F.col("_p") < before + count)
        start, length = F.when(inside, F.col("_p") - before).otherwise(start), F.when(inside, F.lit(n)).otherwise(length)
        before = before + count
    every = F.concat(*[F.col(f"_k{n}") for n in lengths])
    found = []
    for k in range(slices):
        share = keys if slices == 1 else keys.where(F.pmod("key", F.lit(slices)) == k)
        placed = _with_window_keys(rows, lengths).select("_ka", "_kb", "_n", "_words", F.posexplode(every).alias("_p", "key"))
        placed = placed.withColumns({"at": start, "length": length}).join(F.broadcast(share), ["key", "length"], "left_semi")
        found.append(placed.select("_ka", "_kb", "at", "length", "key", F.slice("_words", F.col("at") + 1, F.col("length")).alias("words")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_words, hits, items, _ka, _kb).

    ``hits`` holds the disjoint word ranges (start, end) inside occurrences of
    windows, ``items`` the ids, as sorted strings, of the items with an occurring
    window.  Repeated rows are returned as often; NULL text has no words; an empty
    benchmark hits nothing; items whose id is NULL hit words but are not listed.
    """
    windows, lengths = item_windows(benchmark, item_id, item_text, size)
    found = F.coalesce(words(F.col(text)), F.array().cast("array<string>"))
    every = docs.select(F.col(doc_id).alias("_id"), *identity(doc_id, text), F.size(found).cast("long").alias("n_words"))
    none = [F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")]
    if not lengths:
        return every.select(F.col("_id").alias(doc_id), "n_words", none[0].alias("hits"), none[1].alias("items"), "_ka", "_kb")
    rows = docs.select(*identity(doc_id, text), found.alias("_words"))
    places = _candidates(rows, windows, lengths)
    bytes_of = F.lit(64) + F.coalesce(F.length(F.array_join("window", " ")), F.lit(0)) * 2 + F.size("items") * 24
    checked = places.join(send_if_small(windows, bytes_of), ["key", "length"]).where(F.col("words") == F.col("window"))
    grouped = checked.groupBy("_ka", "_kb").agg(
        F.array_sort(F.collect_set(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("length")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    hit = cut_lineage(grouped.select("_ka", "_kb", _disjoint(F.col("spans")).alias("hits"), "items"))
    joined = every.join(send_if_small(hit, F.lit(64) + 8 * F.size("hits") + 24 * F.size("items")), ["_ka", "_kb"], "left")
    return joined.select(F.col("_id").alias(doc_id), "n_words", F.coalesce("hits", none[0]).alias("hits"), F.coalesce("items", none[1]).alias("items"), "_ka", "_kb")


def _disjoint(spans: Column) -> Column:
    """Sorted ranges, each cut to what lies beyond the ends of those before it; empty ones dropped."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    begin = F.struct(F.lit(0).alias("reach"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        cut = F.struct(F.greatest(x["start"], acc["reach"]).alias("start"), x["end"].alias("end"))
        last = F.element_at(acc["out"], -1)
        joins = (F.size(acc["out"]) > 0) & (cut["start"] == acc["reach"])
        grown = F.when(joins, F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), x["end"].alias("end")))))
        return F.struct(
            F.greatest(x["end"], acc["reach"]).alias("reach"),
            F.when(x["end"] <= acc["reach"], acc["out"]).otherwise(F.coalesce(grown, F.concat(acc["out"], F.array(cut)))).alias("out"),
        )

    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, lambda acc: acc["out"])).otherwise(none)


def hit_words(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", remove: str = "documents", size: int = WINDOW, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without its contaminated documents (``remove="documents"``) or without the hit words (``"spans"``).

    All columns are kept as they are; with spans, each hit word goes together with
    the separators before it.  Documents without hits stay untouched.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    names = docs.columns
    found = find_contamination(docs, benchmark, doc_id, text, size, item_id, item_text).where(F.size("hits") > 0).select("_ka", "_kb", "hits")
    found = cut_lineage(found.dropDuplicates(["_ka", "_kb"]))
    small = send_if_small(found, F.lit(64) + 8 * F.size("hits"))
    # The row travels as one value, so that its columns may have any names.
    keyed = docs.select(F.struct(*[F.col(f"`{n}`").alias(n) for n in names]).alias("_row"), *identity(doc_id, text))
    if remove == "documents":
        return keyed.join(small, ["_ka", "_kb"], "left_anti").select("_row.*")
    joined = keyed.join(small, ["_ka", "_kb"], "left")
    whole = F.col("_row")[text]
    pieces = F.regexp_extract_all(whole, F.lit(f"([{_BETWEEN}]*[^{_BETWEEN}]+)"), F.lit(1))
    tail = F.regexp_extract(whole, f"([{_BETWEEN}]*)$", 1)
    left = F.filter(pieces, lambda x, i: ~F.exists("hits", lambda h: (h["start"] <= i) & (i < h["end"])))
    cleaned = F.when(F.col("hits").isNull(), whole).otherwise(F.concat(F.array_join(left, ""), tail))
    return joined.select(*[(cleaned if n == text else F.col("_row")[n]).alias(n) for n in names])


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated.  Repeated rows give repeated rows."""
    found = find_contamination(docs, benchmark, doc_id, text, size)
    n_hit = hit_words(F.col("hits"))
    return found.select(
        doc_id, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
