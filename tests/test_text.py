"""Golden cases for text functions (FIXTURES.md section 4)."""

from pyspark.sql import functions as F

from cinemetric.functions import text as T


def _one(spark, col, values, schema="t string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col).collect()]


def test_routes(spark):
    vals = ["one two three four five six seven eight", "a b c d e f g h i", "word", ""]
    assert _one(spark, T.model_used("t"), vals) == ["Multiword", "Sentence", "Single-word", "Single-word"]
    assert _one(spark, T.n_words("t"), [" x y", "  a\tb\nc  "]) == [2, 3]


def test_clean_translation(spark):
    vals = ["The cat, the dog and a bird - yes", "hand", "banana split", "one... two", "...", "To the top."]
    got = _one(spark, T.clean_translation("t"), vals)
    assert got[:4] == ["cat dog", "h", "banansplit", "one"]
    # pure ellipsis keeps the text; then punctuation is stripped
    assert got[4] == ""
    assert got[5] == "top"


def test_clean_translation_whole_words(spark):
    got = _one(spark, T.clean_translation("t", whole_words=True), ["banana split", "the cat"])
    assert got == ["banana split", "cat"]


def test_tokens(spark):
    assert _one(spark, T.tokens("t"), ["hello it's 42"]) == [["hello", "it", "'s", "4", "2"]]


def test_format_scores(spark):
    df = spark.createDataFrame([([2.345, 3.0],)], "a array<double>")
    assert df.select(T.format_scores("a")).first()[0] == "2.35;3.00"


def test_translation_audit(spark):
    df = spark.createDataFrame([("", "x"), ("Hund", "hund"), ("a b c d", "x"), ("dog", "Hund")], "c string, o string")
    got = [r[0] for r in df.select(T.translation_audit("c", "o")).collect()]
    assert got == ["empty", "untranslated", "long", None]


def test_whitespace_and_template(spark):
    assert _one(spark, T.normalize_whitespace("t"), ["  Hello \n  World "]) == ["hello world"]
    df = spark.createDataFrame([("a photo of a {}.", "dog")], "t string, n string")
    assert df.select(T.fill_template("t", "n")).first()[0] == "a photo of a dog."
    assert _one(spark, T.before_ellipsis("t"), ["a...b...c", "none"]) == ["a", "none"]
