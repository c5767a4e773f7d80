import hashlib
import re
from collections import defaultdict

from frames import docs, odd
from pyspark.sql import functions as F
from textweave.llm.digest_index import DigestIndex, deduplicate, keep_first, text_digests
from textweave.session import shared_path


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for i, t in rows:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        ids = [x for x in groups[text] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[text]), i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def test_odd_rows_equal_brute_force(spark):
    df = odd(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = [tuple(r) for r in deduplicate(df, DigestIndex.create(spark)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_hot_text_and_empty_table(spark):
    rows = [(i, "same text" if i % 3 else f"own {i}") for i in range(600)]
    got = [tuple(r) for r in deduplicate(docs(spark, rows), DigestIndex.create(spark)).collect()]
    assert sorted(got) == sorted(brute(rows))
    assert deduplicate(docs(spark, []), DigestIndex.create(spark)).count() == 0


def test_index_persists_and_is_not_filled_twice(spark):
    path = shared_path(spark, "test-index")
    index = DigestIndex.create(spark, path, buckets=3)
    first = text_digests(docs(spark, [(1, "a b"), (2, "c")]))
    index.add(first)
    index.add(first)
    again = DigestIndex.open(spark, path, buckets=3)
    assert again.rows().count() == 2
    more = docs(spark, [(7, "a  b"), (8, "new"), (9, "new")])
    assert [r.keep_id for r in again.unseen(text_digests(more)).collect()] == [8]
    found = {r.doc_id: (r.keep_id, r.kept) for r in deduplicate(more, again).collect()}
    assert found == {7: (1, False), 8: (8, True), 9: (8, False)}
    plan = again.unseen(first)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(digest") == 1


def test_keep_first_keeps_columns_and_rows(spark):
    df = odd(spark)
    kept = keep_first(df, DigestIndex.create(spark))
    assert kept.columns == df.columns
    assert sorted(((r.doc_id is None, r.doc_id) for r in kept.collect())) == [(False, i) for i in (1, 3, 4, 6, 7, 8)] + [(True, None)]


def test_keep_first_tells_rows_by_id_and_text(spark):
    rows = [(1, "a b c d e"), (2, "a  b c d e"), (2, "quite another text"), (3, "x"), (3, "x"), (None, "only here"), (None, "only here"), (None, "x")]
    kept = keep_first(docs(spark, rows), DigestIndex.create(spark)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == [(1, "a b c d e"), (2, "quite another text"), (3, "x"), (None, "only here")]


def test_of_rows_given_twice_the_same_one_stays(spark):
    rows = [(3, "x y", "b"), (3, "x  y", "a"), (3, "x\ty", "c"), (4, "y", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, extra string")
    for given in (df, df.orderBy(F.desc("extra")), df.repartition(3)):
        kept = keep_first(given, DigestIndex.create(spark)).collect()
        assert sorted((r.doc_id, r.extra) for r in kept if r.doc_id == 3) == [(3, "a")] and len(kept) == 2
