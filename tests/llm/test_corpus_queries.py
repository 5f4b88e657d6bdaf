"""Registered queries against their SQL, or against plain Python where SQL can't say it."""

import duckdb
import pandas as pd
import pytest
import sentencepiece

from terrapanel.llm import pieces
from terrapanel.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def rows(df):
    def text(v):
        return "~" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF_DIR).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("name, key", [("op2_sentencepiece", "doc_id"), ("op3_toxicity", "doc_id"), ("op8_language_id", "doc_id"), ("op10_quality", "doc_id")])
def test_one_row_per_document(spark, duck, name, key):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert sorted(got[key]) == [r[0] for r in duck.execute("select doc_id from documents order by 1").fetchall()]


def test_encoding_is_the_librarys(spark, duck):
    import zlib

    import numpy as np

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r["doc_id"]: r for r in QUERIES["op2_sentencepiece"](spark, SF_DIR).collect()}
    for doc_id, text in duck.execute("select doc_id, text from documents").fetchall():
        ids = library.encode(text)
        assert got[doc_id]["n_tokens"] == len(ids) and got[doc_id]["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<i4").tobytes()) and got[doc_id]["round_trip"]


def test_shards_by_rows(spark, duck):
    got = QUERIES["op9_sharding"](spark, SF_DIR).toPandas()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1 and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    import zlib

    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    assert {r.doc_id: (r.size_, r.text_crc32) for r in got.rename(columns={"size": "size_"}).itertuples()} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}


def test_pages(spark, duck):
    import html as h
    import re

    got = {r["page_id"]: r for r in QUERIES["op1_html_extraction"](spark, SF_DIR).collect()}
    for page_id, url, page in duck.execute("select page_id, url, html from pages").fetchall():
        inside = re.sub("</?b>|<br>", " ", page[page.index("<article>") + 9 :].split("</article>")[0])
        blocks = [" ".join(h.unescape(x).split()) for x in re.split("</?p>|</?h1>", inside)]
        text = "\n\n".join(b for b in blocks if b)
        assert (got[page_id]["text"], got[page_id]["n_chars"], got[page_id]["url"]) == (text, len(text), url)


def test_language_on_the_held_out_fold(spark, duck):
    got = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    truth = dict(duck.execute("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    assert (got.lang_pred == got.doc_id.map(truth)).mean() > 0.98


def test_toxicity_on_the_held_out_fold(spark, duck):
    got = QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    truth = dict(duck.execute("select doc_id, toxic from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    known = got[got.doc_id.isin(truth)]
    assert (known.predicted == known.doc_id.map(truth)).mean() > 0.93


def test_quality_without_labels(spark, duck):
    got = QUERIES["op10_quality"](spark, "/root/testdata/sf0.01").toPandas()
    truth = dict(duck.execute("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    known = got[got.doc_id.isin(truth)]
    assert (known.kept.astype(int) == known.doc_id.map(truth)).mean() > 0.98


def test_repeats_against_all_windows(spark, duck):
    from test_suffixes import plain

    texts = duck.execute("select doc_id, text from documents").fetchall()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op12_suffix_dedup"](spark, SF_DIR).collect()}
    assert got == dict(zip([i for i, _ in texts], plain([t for _, t in texts], 200), strict=True))


def test_runs_against_their_definition(spark, duck):
    from test_runs import as_rows, plain_report

    got = {r[0]: r for r in as_rows(QUERIES["op11_periodic_runs"](spark, SF_DIR))}
    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    assert set(got) == set(texts)
    assert all(got[i] == plain_report(i, t) for i, t in texts.items() if len((t or "").split()) <= 1500)
