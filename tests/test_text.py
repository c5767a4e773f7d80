import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from textweave.functions import porter
from textweave.functions import text as tx
from textweave.operators import text


def words(df, column="tokens"):
    return [row[column] for row in df.collect()]


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "text string")


def test_tokenize_keeps_inner_empty_tokens_and_fills_nulls(spark):
    assert words(text.tokenize(texts(spark, "a  B c ", None))) == [["a", "", "b", "c"], [""]]


def test_regex_tokenize(spark):
    assert words(text.regex_tokenize(texts(spark, "a  B c ", "", None))) == [["a", "b", "c"], [], []]
    kept = text.regex_tokenize(texts(spark, "One, two; x"), pattern="[a-z]+", gaps=False, min_token_length=2)
    assert words(kept) == [["one", "two"]]


def test_regex_tokens_equals_the_transformer(spark):
    df = texts(spark, " A b\tc\n", "", "x")
    native = df.select(tx.regex_tokens(F.col("text")).alias("tokens"))
    assert words(native) == words(text.regex_tokenize(df))


def test_normalise(spark):
    df = texts(spark, "The CATS’ “ponies”, can't cannot gonna!  a b", "...", None)
    plain = words(text.normalise(df, stem=False))
    assert plain == [["the", "cats", "’", "“", "ponies", "”", "cant", "can", "not", "gon", "na", "a", "b"], [], None]
    assert words(text.normalise(df))[0][:5] == ["the", "cat", "’", "“", "poni"]


def test_fused_words_split_only_as_whole_words(spark):
    assert words(text.normalise(texts(spark, "cannot cannots wanna gimme cannot"), stem=False)) == [
        ["can", "not", "cannots", "wan", "na", "gim", "me", "can", "not"]
    ]


def test_normalizing_tokenizer_survives_saving(spark, tmp_path):
    df = texts(spark, "Running dogs")
    Pipeline(stages=[text.NormalizingTokenizer(inputCol="text", outputCol="t")]).fit(df).write().save(str(tmp_path / "p"))
    assert words(PipelineModel.load(str(tmp_path / "p")).transform(df), "t") == [["run", "dog"]]


def test_stop_words_and_custom_list(spark):
    df = spark.createDataFrame([(["The", "a", "dog", "CANNOT"],)], "tokens array<string>")
    assert words(text.remove_stop_words(df, "tokens", "kept"), "kept") == [["dog"]]
    assert words(text.remove_stop_words(df, "tokens", "kept", ["dog"], True), "kept") == [["The", "a", "CANNOT"]]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "tokens array<string>")
    assert words(text.ngram(df, "tokens", "pairs"), "pairs") == [["a b", "b c"], [], []]
    assert words(df.select(tx.ngrams(F.col("tokens"), 2).alias("pairs")), "pairs") == [["a b", "b c"], [], []]


def test_sentences(spark):
    assert words(texts(spark, "One. Two! Three?  Four").select(tx.sentences(F.col("text")).alias("s")), "s") == [
        ["One.", "Two!", "Three?", "Four"]
    ]


# Sample words of the published algorithm.
PUBLISHED = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
    "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam", "operator": "oper",
    "feudalism": "feudal", "hopefulness": "hope", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form",
    "electrical": "electr", "goodness": "good", "revival": "reviv", "airliner": "airlin", "adjustable": "adjust",
    "replacement": "replac", "adoption": "adopt", "homologou": "homolog", "activate": "activ", "effective": "effect",
    "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
}


@pytest.mark.parametrize("word, stem", PUBLISHED.items())
def test_porter(word, stem):
    assert porter.stem(word, extended=False) == stem


def test_porter_extended():
    assert [porter.stem(w) for w in ("ties", "dying", "enjoy", "spied", "by", "geology")] == [
        "tie", "die", "enjoy", "spi", "by", "geolog",
    ]


def test_stem_counts_merge_words(spark):
    counts = spark.createDataFrame([("cat", 2), ("cats", 3), ("dog", 1)], "key string, count bigint")
    assert {tuple(r) for r in text.stem_counts(counts).collect()} == {("cat", 5), ("dog", 1)}


def test_tagger_takes_the_most_frequent_tag_then_the_first(spark):
    tagged = spark.createDataFrame(
        [("run", "VB"), ("run", "VB"), ("run", "NN"), ("set", "VB"), ("set", "NN")], "token string, tag string"
    )
    tags = text.train_tagger(tagged)
    assert {tuple(r) for r in tags.collect()} == {("run", "VB"), ("set", "NN")}
    df = spark.createDataFrame([(1, ["set", "x", "run"])], "id int, tokens array<string>")
    found = text.tag_tokens(df, ["id"], "tokens", tags).orderBy("pos").collect()
    assert [tuple(r) for r in found] == [(1, 0, "set", "NN"), (1, 1, "x", None), (1, 2, "run", "VB")]


def test_stolen_property(spark):
    narratives = spark.createDataFrame(
        [
            (1, "MO. PROPERTY STOLEN: LAPTOP, POLICE TV AND LAPTOPS: VALUE 5"),
            (2, "NOTHING TAKEN"),
            (3, None),
            (4, "RADIO: X PROPERTY LIST SUMMARY:POLICE RADIO_GOLD RING"),
        ],
        "id int, narrative string",
    )
    tags = spark.createDataFrame(
        [("laptop", "NN"), ("tv", "NN"), ("polic", "NN"), ("radio", "NN"), ("ring", "NN"), ("mo", "NN")],
        "token string, tag string",
    )
    found = {r[0]: r[1] for r in text.stolen_property(narratives, "id", "narrative", tags).collect()}
    assert found == {1: ["laptop", "polic", "laptop"], 2: [], 3: [], 4: ["radio", "polic", "radio"]}
    tags = tags.union(spark.createDataFrame([("police", "NN")], tags.schema))
    fixed = text.stolen_property(narratives, "id", "narrative", tags, stem=False, fix_removal_list=True)
    assert {r[0]: r[1] for r in fixed.collect()}[1] == ["laptop"]


def test_lemmatize(spark):
    df = spark.createDataFrame([(1, ["mice", "ran", "mice"]), (2, [])], "id int, tokens array<string>")
    lemmas = spark.createDataFrame([("mice", "mouse")], "token string, lemma string")
    found = {r.id: r.lemmas for r in text.lemmatize(df, "id", "tokens", lemmas).collect()}
    assert found == {1: ["mouse", "ran", "mouse"], 2: []}


def test_contracts(spark):
    df = texts(spark, "a")
    with pytest.raises(ValueError):
        text.tokenize(df, "text", "text")
    with pytest.raises(ValueError):
        text.ngram(df, "text", "pairs")
