from datetime import date

import pytest
from pyspark.sql import functions as F

from chronolith.functions import ranking, text, timeexpr

# expression -> forms, granularity, confidence, kind
GOLDEN = [
    ("2024", ["2024"], "year", 1.0, "exact_year"),
    (" 2024-q3 ", ["2024-Q3"], "quarter", 1.0, "exact_quarter"),
    ("Q3-2024", ["2024-Q3"], "quarter", 1.0, "exact_quarter"),
    ("2024Q1", ["2024-Q1"], "quarter", 1.0, "exact_quarter"),
    ("Q1 2024", ["2024-Q1"], "quarter", 0.6, "fuzzy_quarter"),
    ("Q2-Q4 2023", ["2023-Q2", "2023-Q3", "2023-Q4"], "quarter", 0.9, "quarter_range"),
    ("FY2021", ["2021-07"], "month", 0.8, "fiscal_year"),
    ("Fiscal Year 2021", ["2021-07"], "month", 0.8, "fiscal_year"),
    ("March 5th, 2021", ["2021-03-05"], "date", 0.95, "exact_date"),
    ("5 Mar. 2021", ["2021-03-05"], "date", 0.95, "exact_date"),
    ("2021-3-5", ["2021-03-05"], "date", 1.0, "exact_date_iso"),
    ("2021-02-30", ["2021"], "year", 0.5, "fuzzy_year"),
    ("2021-05", ["2021-05"], "month", 1.0, "exact_month"),
    ("2021-W07", ["2021-W07"], "week", 1.0, "exact_week"),
    ("March 2021", ["2021-03"], "month", 0.7, "fuzzy_month"),
    ("on the 7th of March, 2021", ["2021-03-07"], "date", 0.7, "fuzzy_date"),
    ("last year", ["2023"], "year", 0.8, "relative_year"),
    ("THIS YEAR", ["2024"], "year", 0.8, "relative_year"),
    ("current quarter", ["2024-Q2"], "quarter", 0.8, "relative_quarter"),
    ("since 1999 or so", ["1999"], "year", 0.5, "fuzzy_year"),
    ("spring 2024", ["2024"], "year", 0.5, "fuzzy_year"),
    ("long ago", [], "unknown", 0.0, "failed"),
    ("", [], "unknown", 0.0, "failed"),
]


@pytest.mark.parametrize("seasons", [False, True])
def test_normalize_time(spark, seasons):
    extra = [("SPRING 2024", ["2024-03", "2024-04", "2024-05"], "month", 0.9, "exact_season"), ("WINTER-2024", ["2024-12", "2025-01", "2025-02"], "month", 0.9, "exact_season"), ("SPRING-SUMMER 2024", [f"2024-0{m}" for m in range(3, 9)], "month", 0.8, "seasonal_range")]
    golden = [g for g in GOLDEN if not seasons or g[0] != "spring 2024"] + extra * seasons
    df = spark.createDataFrame([(g[0],) for g in golden] + [(None,)], "x string")
    got = {r.x: r.r for r in df.select("x", timeexpr.normalize_time(F.col("x"), date(2024, 5, 5), seasons).alias("r")).collect()}
    assert got[None] is None
    for x, forms, granularity, confidence, kind in golden:
        r = got[x]
        assert (list(r.forms), r.granularity, r.confidence, r.kind) == (forms, granularity, confidence, kind), x


def test_levels_ranges_and_series(spark):
    rows = spark.createDataFrame([("2024",), ("2024-Q2",), ("2024-02",), ("2024-W01",), ("2024-02-29",), ("x",), (None,)], "ts string")
    got = {r.ts: (r.l, r.a, r.b) for r in rows.select("ts", timeexpr.time_level(F.col("ts")).alias("l"), timeexpr.time_start(F.col("ts")).alias("a"), timeexpr.time_end(F.col("ts")).alias("b")).collect()}
    assert got["2024"] == ("year", date(2024, 1, 1), date(2024, 12, 31))
    assert got["2024-Q2"] == ("quarter", date(2024, 4, 1), date(2024, 6, 30))
    assert got["2024-02"] == ("month", date(2024, 2, 1), date(2024, 2, 29))
    assert got["2024-W01"] == ("week", date(2024, 1, 1), date(2024, 1, 7))
    assert got["2024-02-29"] == ("date", date(2024, 2, 29), date(2024, 2, 29))
    assert got["x"] == ("unknown", None, None) and got[None] == (None, None, None)
    one = spark.range(1).select(timeexpr.time_series(F.lit("2023-Q3"), F.lit("2024-Q2"), "quarter").alias("q"), timeexpr.time_series(F.lit("2024"), F.lit("2023"), "year").alias("e"), timeexpr.contains_time(F.lit(date(2024, 1, 1)), F.lit(date(2024, 3, 1)), F.lit("2024-02")).alias("c")).first()
    assert one.q == ["2023-Q3", "2023-Q4", "2024-Q1", "2024-Q2"] and one.e == [] and one.c


def test_overlap_and_distance_follow_years(spark):
    one = spark.range(1).select(
        timeexpr.temporal_overlap(F.lit("2024-Q1"), F.lit("2025-Q1")).alias("a"),
        timeexpr.temporal_distance(F.lit("2024-Q1"), F.lit("2024-Q3")).alias("b"),
        timeexpr.temporal_distance(F.lit("2024Q1"), F.lit("2024Q3")).alias("c"),
        timeexpr.temporal_distance(F.lit("soon"), F.lit("2024")).alias("d"),
        timeexpr.temporal_overlap(F.lit("soon"), F.lit("soon")).alias("e"),
    ).first()
    assert (one.a, one.b, one.c, one.d, one.e) == (True, 0.0, 0.5, 10.0, True)


def test_json_and_values(spark):
    bad = 'Here you are: {"title": "T", "rating": 7.5, "rating": 8, "ok": true,'
    one = spark.range(1).select(text.to_json_map(F.lit('{"a": 1, "b": "x"}')).alias("a"), text.to_json_map(F.lit(bad)).alias("b"), text.to_json_map(F.lit("no")).alias("c"), text.clean_text(F.lit(" a&amp;lt;b\x07 ")).alias("d")).first()
    assert one.a == {"a": "1", "b": "x"} and one.b == {"title": "T", "rating": "8", "ok": "true"} and one.c == {} and one.d == "a&lt;b"
    kinds = spark.createDataFrame([("null",), ("TRUE",), ("-3",), ("2.50",), ('"x"',)], "x string").select(text.parse_value(F.col("x")).alias("v")).collect()
    assert [(r.v.kind, r.v.number, r.v.flag, r.v.text) for r in kinds] == [("null", None, None, None), ("bool", None, True, None), ("int", -3.0, None, None), ("float", 2.5, None, None), ("string", None, None, "x")]


def test_ranking_config():
    for kind in [*ranking.PRESETS, "other"]:
        assert abs(sum(ranking.ranking_config(kind).values()) - 1) < 1e-12
    assert ranking.ranking_config("temporal")["alignment"] == pytest.approx(0.6)
    assert ranking.ranking_config("general", False) == ranking.PRESETS["general"]
    assert ranking.ranking_config("general", False, {"degree": 1.3})["degree"] == pytest.approx(0.65)
