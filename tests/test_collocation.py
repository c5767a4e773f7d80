import pytest

from textweave.plans import collocation as c


def table(spark, *lists):
    return spark.createDataFrame([(list(x),) for x in lists], "tokens array<string>").repartition(3)


def test_known_scores(spark):
    rows = c.collocations(table(spark, "ababc")).collect()
    assert [(r.Bigram, r.Count) for r in rows] == [("a b", 2), ("b a", 1), ("b c", 1)]
    assert [r.tScore for r in rows] == pytest.approx([0.961665, 0.36, 0.68], abs=1e-6)
    assert [r.chiScore for r in rows] == pytest.approx([5.0, 0.0, 1.666667], abs=1e-6)


def test_sorting_types_and_cutoff(spark):
    df = table(spark, "ababc")
    first = {m: [r.Bigram for r in c.collocations(df, sorting_type=m).collect()] for m in (1, 2, 3)}
    assert first[c.CHI_SQUARE] == ["a b", "b c", "b a"]
    assert first[c.T_SCORE] == ["a b", "b c", "b a"]
    assert first[c.CHI_SQUARE_FILTERED] == ["b c", "b a"]
    assert c.collocations(df, cutoff=1).count() == 1
    with pytest.raises(ValueError):
        c.collocations(df, sorting_type="Term_Freq")


def test_texts_do_not_run_into_each_other(spark):
    rows = c.collocations(table(spark, "ab", "ca", "", "d")).collect()
    assert {r.Bigram for r in rows} == {"a b", "c a"}


def test_empty_and_spaced_tokens(spark):
    rows = c.collocations(table(spark, ["", "a b", ""], ["", "a b"])).collect()
    assert {(r.Bigram, r.Count) for r in rows} == {(" a b", 2), ("a b ", 1)}


def test_token_counts(spark):
    assert {tuple(r) for r in c.token_counts(table(spark, "aab", "b"), "tokens").collect()} == {("a", 2), ("b", 2)}
