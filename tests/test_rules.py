"""Rule tables: CLS1, CLS2, CLS3-CLS6, CLS7/CLS8 on literal inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from learnlens.functions import rules
from learnlens.functions.scores import score_band


def expected_category(s, e):
    # First match, as specified.
    if s <= 4 and e <= 4:
        return "struggling"
    if s <= 4 and e >= 7:
        return "hopeful"
    if 5 <= s <= 6 and e <= s:
        return "steady"
    if s <= 6 and e > s:
        return "growth"
    if 7 <= s <= 8 and e == s:
        return "good"
    if s >= 9 and e >= 9:
        return "flying"
    return "between"


def expected_versus(s, p):
    if p is None:
        return None
    low = s < 6
    if s > p:
        return "exceeded_low" if low else "exceeded"
    if s == p:
        return "matched_low" if low else "matched"
    return "short_low" if low else "short"


def test_category_all_hundred_pairs(spark):
    df = spark.createDataFrame([(s, e) for s in range(1, 11) for e in range(1, 11)], "s int, e int")
    got = {(r.s, r.e): r.c for r in
           df.select("s", "e", rules.reflection_category("s", "e").alias("c")).collect()}
    assert len(got) == 100
    for (s, e), c in got.items():
        assert c == expected_category(s, e), (s, e)
    assert set(got.values()) == set(rules.CATEGORY_TEXT)


def test_versus_last_six_cells_and_absent(spark):
    cases = [(s, p) for s in (3, 5, 6, 8) for p in (None, 2, 5, 6, 9)]
    df = spark.createDataFrame(cases, "s int, p int")
    for r in df.select("s", "p", rules.versus_last("s", "p").alias("v")).collect():
        assert r.v == expected_versus(r.s, r.p), (r.s, r.p)


def test_outlook_and_feedback_text(spark):
    df = spark.createDataFrame([(5, 8, None), (5, 3, 5), (7, 7, 9)], "s int, e int, p int")
    out = df.select(
        rules.reflection_category("s", "e").alias("c"), rules.versus_last("s", "p").alias("v"),
        rules.outlook("s", "e").alias("o")).select(
        "c", "v", "o", rules.feedback_text("c", "v", "o").alias("f")).collect()
    assert [r.o for r in out] == ["higher", "dip", "consistent"]
    first = out[0]
    assert first.v is None
    assert first.f == rules.CATEGORY_TEXT["growth"] + " " + rules.OUTLOOK_TEXT["higher"]
    second = out[1]
    assert second.f == " ".join([rules.CATEGORY_TEXT["steady"], rules.VERSUS_TEXT["matched_low"],
                                 rules.OUTLOOK_TEXT["dip"]])
    assert "<br><br>" in out[2].f


def test_engagement_levels(spark):
    df = spark.createDataFrame([(d,) for d in (0, 1, 2, 3, 4, 5, 7)], "d int")
    got = [r.e for r in df.select(rules.engagement("d").alias("e")).collect()]
    assert got == ["No Activity", "Limited", "Limited", "Good", "Good", "Excellent", "Excellent"]


def test_score_bands(spark):
    df = spark.createDataFrame([(59.9,), (60.0,), (79.9,), (80.0,), (None,)], "v double")
    got = [r.b for r in df.select(score_band("v").alias("b")).collect()]
    assert got == ["low", "middle", "middle", "high", None]


def test_block_messages(spark):
    df = spark.createDataFrame([(1, 0, 0, 6), (3, 3, 6, 6), (5, 6, 2, 6), (3, 6, 0, 6)],
                               "b int, c int, pc int, pt int")
    got = df.select(rules.block_message("c", F.lit(6)).alias("m"),
                    rules.previous_block_message("b", "pc", "pt").alias("p")).collect()
    assert got[0].m == rules.BLOCK_NONE_DONE and got[0].p == rules.NO_PREVIOUS_BLOCK
    assert got[1].m == rules.BLOCK_SOME_DONE and got[1].p == rules.PREVIOUS_ALL_DONE
    assert got[2].m == rules.BLOCK_ALL_DONE
    assert got[2].p == rules.PREVIOUS_SOME_DONE % (2, 6)
    assert got[3].p == rules.PREVIOUS_NONE_DONE


def test_streak_text(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (5,)], "s int")
    got = [r.t for r in df.select(rules.streak_text("s").alias("t")).collect()]
    assert got[:2] == [None, None]
    assert got[2] == rules.STREAK_TEXT % (2, 2)
