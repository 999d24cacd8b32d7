from pyspark.sql import functions as F

from threadloom.functions import keys, lexicon, text


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c"))).first()[0]


def test_ids_and_authors(spark):
    for raw, want in ((" T1_AbC ", "abc"), ("t3_x", "x"), (" x1​", "x1"), ("t1_", None), ("", None), (None, None)):
        assert one(spark, raw, keys.plain_id) == want
    for raw, want in (("", None), ("[deleted]", None), ("AutoModerator", None), (None, None), (" Bob ", "bob")):
        assert one(spark, raw, keys.author) == want


def test_numbers(spark):
    for raw, want in (("3.9", 3), ("x", 0), ("", 0), ("nan", 0), ("-2.7", -2), (None, 0), ("3d", 0)):
        assert one(spark, raw, keys.long_or_zero) == want


def test_lexicon(spark):
    match = lambda c: lexicon.has_term(c, ["sheep", "shut up"])
    assert [one(spark, t, match) for t in ("Sheepish", "a sheep!", "SHUT UP", None, "")] == [0, 1, 1, 0, 0]
    assert [one(spark, t, lexicon.candidate) for t in ("source?", "source? yes", "false.", "Fact-check", None)] == [False, False, True, True, False]


def test_text(spark):
    assert one(spark, "a b \tc", text.compact) == "a b c"
    assert one(spark, None, text.word_count) == 0
    assert one(spark, "x " * 200_000, text.word_count) == 200_000
    assert one(spark, [3.0, 1.0], lambda c: F.round(text.entropy_of(c), 4), "array<double>") == 0.5623
    assert one(spark, [], text.entropy_of, "array<double>") == 0.0
    assert one(spark, 0.25, lambda c: text.score_bin(c, [0, 0.25, 1], ["a", "b"]), "double") == "b"


def test_queries(spark):
    df = spark.createDataFrame([("Masks Trap heat", ['"no" "such"', "trap masks"]), (None, ["x"]), ("y", [])], "t string, q array<string>")
    got = [r[0] for r in df.select(lexicon.first_matching_query(F.col("t"), F.col("q"))).collect()]
    assert got == ["trap masks", None, None]
