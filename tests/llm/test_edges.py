"""NULLs, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest

from terrapanel.llm import decontamination, embeddings, language, minhash, pieces, quality, sharding, toxicity, urlrules, wrappers

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def model():
    return pieces.load_model()


def test_encode(spark, odd_docs, no_docs, model):
    got = pieces.decode(pieces.encode(odd_docs, model), model).collect()
    assert sorted(r["decoded"] for r in got) == sorted(r["text"] or "" for r in odd_docs.collect())
    assert all(r["round_trip"] for r in got) and all(len(r["ids"]) == 0 for r in got if r["doc_id"] in (3, 4))
    assert pieces.decode(pieces.encode(no_docs, model), model).count() == 0


def test_toxicity(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (7, None, 0), (None, 1, 1), (8, 1, None)], LABELS)
    got = toxicity.report(odd_docs, labels).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.report(no_docs, labels).count() == 0
    assert toxicity.report(odd_docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_language(odd_docs, no_docs):
    got = language.report(odd_docs).collect()
    assert len(got) == 13
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5, 6, 1)} == {3: "und", 4: "und", 5: "und", 6: "und", 1: "en"}
    assert language.report(no_docs).count() == 0


def test_quality(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in quality.report(odd_docs).collect()}
    assert all(got[i]["score"] == 0 and not got[i]["kept"] for i in (3, 4, 5))
    assert quality.report(no_docs).count() == 0


def test_near_duplicates(odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs).collect()
    classes = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    assert len(got) == 13 and classes == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10}
    assert all(r["kept"] and r["class_id"] is None for r in got if r["doc_id"] is None)
    assert minhash.near_duplicates(no_docs).count() == 0
    kept = minhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, -1, 1, 3, 4, 5, 6, 7, 9, 10]


def test_decontamination(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "QUICK brown!"), (2, None), (3, ""), (None, "lazy dog"), (1, "quick brown")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.report(odd_docs, items).where("doc_id is not null").collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (16, 4, 1, True)
    assert got[3]["n_words"] == 0 and not got[3]["contaminated"]
    assert decontamination.report(odd_docs, items).count() == 13
    assert decontamination.report(odd_docs, items.limit(0)).where("contaminated").count() == 0
    assert decontamination.report(no_docs, items).count() == 0
    whole = decontamination.decontaminate(odd_docs, items)
    assert whole.columns == odd_docs.columns and sorted(r["doc_id"] or 0 for r in whole.collect()) == [0, 3, 4, 5, 6, 7, 8, 9, 10]
    spans = decontamination.decontaminate(odd_docs, items, remove="spans")
    texts = {r["doc_id"]: r["text"] for r in spans.where("doc_id is not null").collect()}
    assert texts[1] == "the fox jumps over the and runs away from the angry farmer" and texts[9] == "ééé ▁▁ 日本 \x00 x" and texts[3] is None
    assert spans.columns == odd_docs.columns and spans.count() == 13


def test_sharding(spark, odd_docs, no_docs, tmp_path):
    got = sharding.report(odd_docs).collect()
    assert len(got) == 13 and sorted(r["shard"] + 16 * r["slot"] for r in got) == list(range(13))
    assert sharding.report(no_docs).count() == 0
    small = sharding.shuffle_into_shards(odd_docs, shards=3, bucket_bytes=1000)
    assert small.count() == 13 and small.columns == [*odd_docs.columns, "_shard", "_slot"]
    copies = spark.range(3000).selectExpr("cast(null as long) doc_id", "'one and the same' text", "id as _shard")
    dealt = sharding.shuffle_into_shards(copies, shards=4, bucket_bytes=2000)
    assert sorted((r["_shard"], r["_slot"]) for r in dealt.collect()) == [(s, k) for s in range(4) for k in range(750)]
    sharding.write_shards(odd_docs, str(tmp_path / "shards"), shards=4)
    assert spark.read.parquet(str(tmp_path / "shards")).groupBy("_shard").count().count() == 4


def test_url_rules(spark):
    urls = [None, "", "no scheme/en/", "http://", "HTTP://A.COM/x", "http://Example.com/en/x?q#f", "http://www.example.com/en/", "http://www.example.com/EN/", "x://net/es/", "x://a.b.net/es", "x://anet/es/1", "x://com"]
    pages = spark.createDataFrame([(i, u, "z", "y", "w") for i, u in enumerate(urls)] + [(None, "http://a.com/", None, None, None), (4, urls[4], "z", "y", "w")], "page_id long, url string, html string, host string, key string")
    rules = urlrules.rule_table(spark, [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")])
    got = urlrules.judge(pages, rules, default="skip").collect()
    by_id = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == 14
    assert by_id[0] == by_id[1] == by_id[2] == by_id[3] == ("", "", None, "skip")
    assert by_id[4] == ("a.com", "/x", "com/", "allow") and by_id[None] == ("a.com", "/", "com/", "allow")
    assert by_id[5] == ("example.com", "/en/x", "example.com/en/", "block")
    assert by_id[6][2:] == ("www.example.com/en/", "allow") and by_id[7][2:] == ("com/", "allow")
    assert by_id[8][2:] == ("net/es/", "block") and by_id[9][2:] == by_id[10][2:] == by_id[11][2:] == (None, "skip")
    assert urlrules.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlrules.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_embeddings(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [None, 1.0], 1), (8, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0], 1), (10, [], 1)]
    table = spark.createDataFrame([(*r, 0, "k", [1]) for r in rows], "vec_id long, embedding array<float>, label int, id long, key string, keys array<int>")
    got = embeddings.near_duplicate_vectors(table).collect()
    by_id = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert len(got) == 12 and by_id[1] == (1, 1, True) and by_id[2] == (1, 1, False)
    assert all(by_id[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)) and by_id[None] == (0, None, True)
    assert embeddings.near_duplicate_vectors(table.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "http://a.b/x", "<article><p>One &amp; two<p>three</article>"), (2, "http://a.b/y", None), (3, None, "<p>alone</p>"), (None, "http://a.b/z", ""), (1, "http://a.b/x", "<article><p>One &amp; two<p>three</article>"), (4, "http://a.b/q", "<article>" + "<p>long text</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame([(*r, "h", "s", "t") for r in rows], "page_id long, url string, html string, host string, slots string, id string")
    got = {r["page_id"]: r for r in wrappers.report(pages).collect()}
    assert got[1]["text"] == "One & two\n\nthree" and got[2]["text"] == got[None]["text"] == "" and got[3]["text"] == "alone"
    assert got[4]["n_chars"] == 20_000 * 11 - 2 and wrappers.report(pages).count() == 6
    assert wrappers.report(pages.limit(0)).count() == 0
