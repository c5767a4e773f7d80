"""The registered queries of the subpackage, and the pipeline."""

import os

import corpus_pipeline
import pytest
from compare import connect, difference
from frames import clashing, docs, odd
from textweave.llm import ball_hashing, digest_index, ftrl_toxicity, registered, soft_mixing
from textweave.llm.tables import domains, load

SF = os.environ.get("TEXTWEAVE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_equals_sql(spark, name):
    assert difference(registered.QUERIES[name](spark, SF), connect(SF), registered.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(registered.QUERIES) - set(registered.ORACLES)))
def test_gives_rows(spark, name):
    df = registered.QUERIES[name](spark, SF)
    table = {"op1_text_density": "pages", "op4_vector_graph": "embeddings"}.get(name, "documents")
    n = load(spark, SF, table).count()
    rows = df.toPandas()
    assert len(rows) >= (n if name.startswith("op") else 1)


def test_stages_are_their_operators(spark, tmp_path):
    """Each stage against the operator's verdicts on the rows that the stage was given."""
    given = load(spark, SF, "documents")
    labels = load(spark, SF, "labels")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    clean = ftrl_toxicity.toxicity(given, labels).filter(f"score < {corpus_pipeline.REJECTED_FROM}")
    one = corpus_pipeline.toxicity(spark, given, SF)
    assert ids(one) == ids(clean) and one.columns == given.columns
    two = corpus_pipeline.exact_dedup(spark, one, SF)
    assert ids(two) == ids(digest_index.deduplicate(one, digest_index.DigestIndex.create(spark)).filter("kept"))
    three = corpus_pipeline.simhash_dedup(spark, two, SF)
    assert ids(three) == ids(ball_hashing.near_duplicates(two).filter("kept"))
    four = corpus_pipeline.mixing(spark, three, SF)
    assert set(ids(four)) == set(ids(three)) and four.columns == given.columns
    rated = soft_mixing.rates(three, domains(labels), corpus_pipeline.TARGETS, 1.0, 4.0)
    wanted = {r.doc_id: r.rate for r in rated.collect()}
    times = {r.doc_id: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert all(int(rate) <= times[i] <= int(rate) + 1 for i, rate in wanted.items())
    five = corpus_pipeline.packing(spark, four, SF)
    assert five.agg({"length": "sum"}).first()[0] == five.filter("start = 0").agg({"doc_tokens": "sum"}).first()[0]


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_pipeline_of_odd_tables(spark, tmp_path, rows):
    df = odd(spark, 3_000) if rows == "odd" else clashing(docs(spark, []))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    label_rows = [(4, 1, 0), (7, 0, 0), (None, 1, 1), (6, None, None)] if rows == "odd" else []
    spark.createDataFrame(label_rows, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() >= (6 if rows == "odd" else 0)
