"""The stages, each on its own input, against plain forms."""

import duckdb
import pytest

import corpus_pipeline
from terrapanel.llm import pieces

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(str(folder / str(number)))
        docs = spark.read.parquet(str(folder / str(number)))
        out.append(docs)
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(spark, written):
    columns = spark.read.parquet(f"{SF_DIR}/documents.parquet").columns
    assert all(df.columns == columns for df in written[:-1])


def test_toxic_and_poor_documents_go_and_clean_ones_stay(written):
    labels = duckdb.sql(f"select doc_id, quality, toxic from '{SF_DIR}/labels.parquet'").fetchall()
    after_toxic, after_poor = ids(written[0]), ids(written[1])
    assert sum(i not in after_toxic for i, _, t in labels if t) >= 0.9 * sum(t for *_, t in labels)
    assert sum(i in after_toxic for i, _, t in labels if not t) >= 0.99 * sum(1 - t for *_, t in labels)
    judged = [(i, q) for i, q, _ in labels if i in after_toxic]
    assert sum((i in after_poor) == bool(q) for i, q in judged) >= 0.98 * len(judged)


def test_one_of_each_class_stays(spark, written):
    from terrapanel.llm.queries import MINHASH_SQL

    con = duckdb.connect()
    con.register("documents", written[1].toPandas())
    want = {r[0] for r in con.execute(f"select doc_id from ({MINHASH_SQL}) where kept").fetchall()}
    assert ids(written[2]) == want


def test_contaminated_documents_go(written):
    from terrapanel.llm.queries import DECONTAMINATION_SQL

    con = duckdb.connect()
    con.register("documents", written[2].toPandas())
    con.execute(f"create view benchmark as select * from '{SF_DIR}/benchmark.parquet'")
    want = {r[0] for r in con.execute(f"select doc_id from ({DECONTAMINATION_SQL}) where not contaminated").fetchall()}
    assert ids(written[3]) == want and len(want) < written[2].count()


def test_the_last_stage_is_lossless(written):
    model = pieces.load_model()
    texts = {r["doc_id"]: r["text"] for r in written[3].select("doc_id", "text").collect()}
    rows = written[4].collect()
    assert {r["doc_id"] for r in rows} == set(texts) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert all("".join(model.pieces[i] for i in r["ids"] if i > 258).replace("▁", " ").strip() for r in rows)


def test_run_is_the_stages_in_a_row(spark, written):
    assert ids(corpus_pipeline.run(spark, SF_DIR)) == ids(written[4])


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0


def test_rows_are_judged_by_their_own_text_whatever_their_id(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    kept = docs.join(labels.where("toxic = 0 and quality = 1"), "doc_id", "left_semi").limit(300)
    wrong = docs.join(labels.where("toxic = 1 or quality = 0"), "doc_id", "left_semi")
    # Every clean row shares its id with a wrong one, and the wrong ones are there without an id too.
    shared = kept.agg(F.min("doc_id")).first()[0]
    mixed = docs.unionByName(wrong.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(wrong.withColumn("doc_id", F.lit(shared)))
    left = corpus_pipeline.drop_poor(spark, corpus_pipeline.drop_toxic(spark, mixed, SF_DIR), SF_DIR)
    assert left.columns == docs.columns
    assert left.where("doc_id is null").count() <= 0.1 * wrong.count()
    assert left.join(kept.where(F.col("doc_id") == shared).select("text"), "text", "left_semi").count() >= 1
