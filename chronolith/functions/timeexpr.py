"""Time expressions as Spark columns: normalisation, levels, parents, ranges, overlap and distance.

The canonical grammar is ``YYYY``, ``YYYY-QN``, ``YYYY-MM``, ``YYYY-Www`` (ISO weeks) and ``YYYY-MM-DD``. Everything is
built from native expressions, so filters over time columns stay in code generation. Nulls give null.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names and their numbers (fixed values).
MONTHS = {
    "JANUARY": 1,
    "FEBRUARY": 2,
    "MARCH": 3,
    "APRIL": 4,
    "MAY": 5,
    "JUNE": 6,
    "JULY": 7,
    "AUGUST": 8,
    "SEPTEMBER": 9,
    "OCTOBER": 10,
    "NOVEMBER": 11,
    "DECEMBER": 12,
    "JAN": 1,
    "FEB": 2,
    "MAR": 3,
    "APR": 4,
    "JUN": 6,
    "JUL": 7,
    "AUG": 8,
    "SEP": 9,
    "SEPT": 9,
    "OCT": 10,
    "NOV": 11,
    "DEC": 12,
}
# Months of the seasons; winter begins in its year's December (fixed values).
SEASONS = {"SPRING": [3, 4, 5], "SUMMER": [6, 7, 8], "FALL": [9, 10, 11], "AUTUMN": [9, 10, 11], "WINTER": [12, 1, 2]}
# Levels of the hierarchy (fixed values).
LEVELS = {"year": 0, "quarter": 1, "month": 2, "week": 2, "date": 3, "unknown": 3}

_MONTH_WORD = "(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + ")"
_SEASON_WORD = "(SPRING|SUMMER|FALL|AUTUMN|WINTER)"

RESULT = "struct<forms:array<string>,granularity:string,confidence:double,kind:string,start:date,end:date>"


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def month_number(name: Column) -> Column:
    """Number of a month name or its abbreviation; null for other words."""
    return F.element_at(literal_map(MONTHS), F.upper(F.btrim(name)))


def _pad(n: Column, width: int = 2) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _get(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _result(forms: Column, granularity: str, confidence: float, kind: str, start: Column, end: Column) -> Column:
    return F.struct(
        forms.alias("forms"), F.lit(granularity).alias("granularity"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("kind"), start.cast("date").alias("start"), end.cast("date").alias("end")
    )


def _year_result(year: Column, confidence: float, kind: str) -> Column:
    y = year.cast("int")
    return _result(F.array(_pad(y, 4)), "year", confidence, kind, F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31)))


def _quarter_result(year: Column, first: Column, last: Column, confidence: float, kind: str) -> Column:
    y, a, b = year.cast("int"), first.cast("int"), last.cast("int")
    forms = F.transform(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>")), lambda q: F.concat(_pad(y, 4), F.lit("-Q"), q.cast("string")))
    return _result(forms, "quarter", confidence, kind, F.make_date(y, a * 3 - 2, F.lit(1)), F.last_day(F.make_date(y, b * 3, F.lit(1))))


def _month_result(year: Column, month: Column, confidence: float, kind: str) -> Column:
    y, m = year.cast("int"), month.cast("int")
    first = F.make_date(y, m, F.lit(1))
    return _result(F.array(F.concat(_pad(y, 4), F.lit("-"), _pad(m))), "month", confidence, kind, first, F.last_day(first))


def _date_result(day: Column, confidence: float, kind: str) -> Column:
    return _result(F.array(F.date_format(day, "yyyy-MM-dd")), "date", confidence, kind, day, day)


def _try_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null for one that the calendar doesn't have."""
    return F.try_to_date(F.concat_ws("-", _pad(year, 4), _pad(month), _pad(day)), "yyyy-MM-dd")


def clean_expression(text: Column) -> Column:
    """Upper case, without quotes and white space around."""
    return F.upper(F.regexp_replace(text, "^[ \\t\\n\\r\"']+|[ \\t\\n\\r\"']+$", ""))


def normalize_time(text: Column, reference: date = date(2024, 1, 1), seasons: bool = False) -> Column:
    """Struct of canonical forms, granularity, confidence, kind and first and last day of a time expression.

    Branches in order: ranges of quarters (and seasons, if asked for), exact forms, forms relative to ``reference``,
    fuzzy ones; what meets none is ``failed`` with no form. ISO months and weeks are exact forms of their own level, and a
    month with a year, no day between, is that month.
    """
    e = clean_expression(text)
    bare = F.regexp_replace(F.regexp_replace(e, "[,.]", ""), "([0-9]+)(ST|ND|RD|TH)", "$1")
    branches: list[tuple[Column, Column]] = []

    span = "^Q([1-4])-Q([1-4])[ ]+([0-9]{4})"
    branches.append((e.rlike(span), _quarter_result(_get(e, span, 3), _get(e, span, 1), _get(e, span, 2), 0.9, "quarter_range")))
    if seasons:
        span = f"^{_SEASON_WORD}-{_SEASON_WORD}[ ]+([0-9]{{4}})"
        order = literal_map({"SPRING": 1, "SUMMER": 2, "FALL": 3, "AUTUMN": 3, "WINTER": 4})
        y, a, b = _get(e, span, 3).cast("int"), F.element_at(order, _get(e, span, 1)), F.element_at(order, _get(e, span, 2))
        last = F.when(b < a, b + 4).otherwise(b)
        # months 3, 4 .. counted on from March of the year; beyond December they are the next year's
        months = F.sequence(a * 3, last * 3 + 2)
        forms = F.transform(months, lambda m: F.concat(_pad(y + F.floor((m - 1) / 12), 4), F.lit("-"), _pad(F.pmod(m - 1, F.lit(12)) + 1)))
        start = F.make_date(y, a * 3, F.lit(1))
        branches.append((e.rlike(span), _result(forms, "month", 0.8, "seasonal_range", start, F.last_day(F.add_months(start, (last - a) * 3 + 2)))))

    branches.append((e.rlike("^[0-9]{4}$"), _year_result(e, 1.0, "exact_year")))
    fiscal = "^(FY|FISCAL|FISCAL[ ]+YEAR)[ ]*([0-9]{4})$"
    year = _get(e, fiscal, 2).cast("int")
    branches.append((e.rlike(fiscal), _result(F.array(F.concat(_pad(year, 4), F.lit("-07"))), "month", 0.8, "fiscal_year", F.make_date(year, F.lit(7), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31)))))
    form = f"^{_MONTH_WORD}[ ]+([0-9]{{1,2}})[ ]+([0-9]{{4}})"
    day = _try_date(_get(bare, form, 3), month_number(_get(bare, form, 1)), _get(bare, form, 2))
    branches.append((bare.rlike(form) & day.isNotNull(), _date_result(day, 0.95, "exact_date")))
    form = f"^([0-9]{{1,2}})[ ]+{_MONTH_WORD}[ ]+([0-9]{{4}})"
    day = _try_date(_get(bare, form, 3), month_number(_get(bare, form, 2)), _get(bare, form, 1))
    branches.append((bare.rlike(form) & day.isNotNull(), _date_result(day, 0.95, "exact_date")))
    form = "^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
    day = _try_date(_get(e, form, 1), _get(e, form, 2), _get(e, form, 3))
    branches.append((e.rlike(form) & day.isNotNull(), _date_result(day, 1.0, "exact_date_iso")))
    form = "^(?:([0-9]{4})-?Q([1-4])|Q([1-4])-?([0-9]{4}))"
    y, q = F.concat(_get(e, form, 1), _get(e, form, 4)), F.concat(_get(e, form, 2), _get(e, form, 3))
    branches.append((e.rlike(form), _quarter_result(y, q, q, 1.0, "exact_quarter")))
    form = "^([0-9]{4})-(0[1-9]|1[0-2])$"
    branches.append((e.rlike(form), _month_result(_get(e, form, 1), _get(e, form, 2), 1.0, "exact_month")))
    form = "^([0-9]{4})-W(0[1-9]|[1-4][0-9]|5[0-3])$"
    monday = iso_week_start(_get(e, form, 1), _get(e, form, 2))
    branches.append((e.rlike(form), _result(F.array(e), "week", 1.0, "exact_week", monday, F.date_add(monday, 6))))
    if seasons:
        form = f"^(?:{_SEASON_WORD}[ -]+([0-9]{{4}})|([0-9]{{4}})-{_SEASON_WORD})"
        season = F.concat(_get(e, form, 1), _get(e, form, 4))
        y = F.concat(_get(e, form, 2), _get(e, form, 3)).cast("int")
        first = F.element_at(literal_map({k: v[0] for k, v in SEASONS.items()}), season)
        start = F.make_date(y, first, F.lit(1))
        forms = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.date_format(F.add_months(start, i), "yyyy-MM"))
        branches.append((e.rlike(form), _result(forms, "month", 0.9, "exact_season", start, F.last_day(F.add_months(start, 2)))))

    now = F.lit(reference)
    branches.append((e.isin("THIS YEAR", "CURRENT YEAR"), _year_result(F.year(now), 0.8, "relative_year")))
    branches.append((e == "LAST YEAR", _year_result(F.year(now) - 1, 0.8, "relative_year")))
    branches.append((e.isin("THIS QUARTER", "CURRENT QUARTER"), _quarter_result(F.year(now), F.quarter(now), F.quarter(now), 0.8, "relative_quarter")))

    any_year = _get(e, "([0-9]{4})", 1)
    has_year = e.rlike("[0-9]{4}")
    branches.append((has_year & e.rlike("Q[1-4]"), _quarter_result(any_year, _get(e, "Q([1-4])", 1), _get(e, "Q([1-4])", 1), 0.6, "fuzzy_quarter")))
    month = month_number(_get(e, _MONTH_WORD, 1))
    loose = F.regexp_replace(F.regexp_replace(bare, "[0-9]{4}", " "), "[^0-9]+", " ")
    day = _try_date(any_year, month, _get(loose, "([0-9]{1,2})", 1))
    branches.append((has_year & e.rlike(_MONTH_WORD) & loose.rlike("[0-9]") & day.isNotNull(), _date_result(day, 0.7, "fuzzy_date")))
    branches.append((has_year & e.rlike(_MONTH_WORD), _month_result(any_year, month, 0.7, "fuzzy_month")))
    branches.append((has_year, _year_result(any_year, 0.5, "fuzzy_year")))

    failed = _result(F.array().cast("array<string>"), "unknown", 0.0, "failed", F.lit(None), F.lit(None))
    out = F.when(branches[0][0], branches[0][1])
    for condition, value in branches[1:]:
        out = out.when(condition, value)
    return F.when(text.isNotNull(), out.otherwise(failed))


def iso_week_start(year: Column, week: Column) -> Column:
    """Monday of an ISO week: that of the week that holds January the fourth, and so many weeks on."""
    fourth = F.make_date(year.cast("int"), F.lit(1), F.lit(4))
    return F.date_add(F.date_sub(fourth, F.weekday(fourth)), ((week.cast("int") - 1) * 7).cast("int"))


def canonical(text: Column, reference: date = date(2024, 1, 1), seasons: bool = False) -> Column:
    """First canonical form, or the cleaned expression where there is none."""
    return F.coalesce(F.get(normalize_time(text, reference, seasons)["forms"], F.lit(0)), clean_expression(text))


def time_level(ts: Column) -> Column:
    """Level name of a canonical time; ``unknown`` for anything else."""
    return (
        F.when(ts.rlike("^[0-9]{4}$"), "year")
        .when(ts.rlike("^[0-9]{4}-Q[1-4]$"), "quarter")
        .when(ts.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), "month")
        .when(ts.rlike("^[0-9]{4}-W(0[1-9]|[1-4][0-9]|5[0-3])$"), "week")
        .when(ts.rlike("^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"), "date")
        .when(ts.isNotNull(), "unknown")
    )


def level_number(level: Column) -> Column:
    return F.element_at(literal_map(LEVELS), level)


def time_start(ts: Column) -> Column:
    """First day of a canonical time."""
    y = F.substring(ts, 1, 4).cast("int")
    return (
        F.when(ts.rlike("^[0-9]{4}$"), F.make_date(y, F.lit(1), F.lit(1)))
        .when(ts.rlike("^[0-9]{4}-Q[1-4]$"), F.make_date(y, F.substring(ts, 7, 1).cast("int") * 3 - 2, F.lit(1)))
        .when(ts.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), F.make_date(y, F.substring(ts, 6, 2).cast("int"), F.lit(1)))
        .when(ts.rlike("^[0-9]{4}-W[0-5][0-9]$"), iso_week_start(y, F.substring(ts, 7, 2)))
        .when(ts.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(ts, "yyyy-MM-dd"))
    )


def time_end(ts: Column) -> Column:
    """Last day of a canonical time."""
    start, level = time_start(ts), time_level(ts)
    return (
        F.when(level == "year", F.make_date(F.year(start), F.lit(12), F.lit(31)))
        .when(level == "quarter", F.last_day(F.add_months(start, 2)))
        .when(level == "month", F.last_day(start))
        .when(level == "week", F.date_add(start, 6))
        .when(level == "date", start)
    )


def format_level(day: Column, level: str) -> Column:
    """The canonical time of a level that holds a day."""
    year = F.date_format(day, "yyyy")
    return {
        "year": lambda: year,
        "quarter": lambda: F.concat(year, F.lit("-Q"), F.quarter(day).cast("string")),
        "month": lambda: F.date_format(day, "yyyy-MM"),
        "week": lambda: F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), _pad(F.weekofyear(day))),
        "date": lambda: F.date_format(day, "yyyy-MM-dd"),
    }[level]()


def parent_time(ts: Column, level: str) -> Column:
    """The ancestor of a canonical time at a level."""
    return format_level(time_start(ts), level)


def time_path(ts: Column) -> Column:
    """array<struct<kind, ts>> of a canonical time: its ancestors from the year down, then itself; null for anything else.

    Weeks hang on their quarter.
    """
    kind, start = time_level(ts), time_start(ts)
    rank = F.element_at(literal_map(LEVELS), kind)
    above = F.array(*[F.when(F.lit(i) < rank, F.struct(F.lit(lv).alias("kind"), format_level(start, lv).alias("ts"))) for i, lv in enumerate(["year", "quarter", "month"])])
    return F.when(kind != "unknown", F.concat(F.array_compact(above), F.array(F.struct(kind.alias("kind"), ts.alias("ts")))))


def time_series(start: Column, end: Column, level: str) -> Column:
    """All canonical times of a level from that of ``start`` to the last one that begins by the start of ``end``."""
    step = {"year": "INTERVAL 1 YEAR", "quarter": "INTERVAL 3 MONTH", "month": "INTERVAL 1 MONTH", "week": "INTERVAL 7 DAY", "date": "INTERVAL 1 DAY"}[level]
    a, b = time_start(start), time_start(end)
    return F.when(a <= b, F.transform(F.sequence(a, b, F.expr(step)), lambda d: format_level(d, level))).otherwise(F.array().cast("array<string>"))


def expansions(text: Column, limit: int = 10) -> Column:
    """A time and the finer ones in it - quarters and months of a year, months of a quarter -, sorted, at most ``limit``."""
    found = normalize_time(text)
    months = lambda first, n: F.transform(F.sequence(first, first + n - 1), lambda m: _pad(m))

    def finer(form: Column) -> Column:
        y = F.substring(form, 1, 4)
        quarters = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda q: F.concat(y, F.lit("-Q"), q.cast("string")))
        return (
            F.when(form.rlike("^[0-9]{4}$"), F.concat(F.array(form), quarters, F.transform(months(F.lit(1), 12), lambda m: F.concat(y, F.lit("-"), m))))
            .when(form.rlike("^[0-9]{4}-Q[1-4]$"), F.concat(F.array(form), F.transform(months(F.substring(form, 7, 1).cast("int") * 3 - 2, 3), lambda m: F.concat(y, F.lit("-"), m))))
            .otherwise(F.array(form))
        )

    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.transform(found["forms"], finer)))), 1, limit)


def extract_year(ts: Column) -> Column:
    """The first four digits that stand alone, as a number."""
    return F.regexp_extract(ts, r"\b([0-9]{4})\b", 1).try_cast("int")


def extract_quarter(ts: Column) -> Column:
    """struct<year, quarter>, or null."""
    form = r"(?i)\b([0-9]{4})[- ]?Q([1-4])\b"
    return F.when(ts.rlike(form), F.struct(F.regexp_extract(ts, form, 1).cast("int").alias("year"), F.regexp_extract(ts, form, 2).cast("int").alias("quarter")))


def temporal_overlap(a: Column, b: Column) -> Column:
    """Equal, or of years one apart at most, or of quarters in such years."""
    ya, yb, qa, qb = extract_year(a), extract_year(b), extract_quarter(a), extract_quarter(b)
    by_year = F.when(ya.isNotNull() & yb.isNotNull(), F.abs(ya - yb) <= 1)
    by_quarter = F.when(qa.isNotNull() & qb.isNotNull(), F.abs(qa["year"] - qb["year"]) <= 1)
    return F.when(a == b, True).otherwise(F.coalesce(by_year, by_quarter, F.lit(False)))


def temporal_distance(a: Column, b: Column) -> Column:
    """Years apart; quarters apart over four where no plain year is in sight; 10 for what has neither."""
    ya, yb, qa, qb = extract_year(a), extract_year(b), extract_quarter(a), extract_quarter(b)
    by_year = F.when(ya.isNotNull() & yb.isNotNull(), F.abs(ya - yb).cast("double"))
    by_quarter = F.when(qa.isNotNull() & qb.isNotNull(), F.abs(qa["year"] * 4 + qa["quarter"] - qb["year"] * 4 - qb["quarter"]) / 4.0)
    return F.coalesce(by_year, by_quarter, F.lit(10.0))


def basic_normalize(text: Column) -> Column:
    """The simple rules: padded ISO dates, quarters either way round, seasons to their middle month; else as it is."""
    s = F.regexp_replace(text, "^[ \\t\\n\\r\"']+|[ \\t\\n\\r\"']+$", "")
    iso, front, back = "^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", "^[Qq]([1-4])[ ]*-?[ ]*([0-9]{4})", "^([0-9]{4})[ ]+[Qq]([1-4])"
    day = _try_date(_get(s, iso, 1), _get(s, iso, 2), _get(s, iso, 3))
    season = f"(?i)^{_SEASON_WORD}[ ]*([0-9]{{4}})"
    middle = literal_map({"SPRING": "04", "SUMMER": "07", "FALL": "10", "AUTUMN": "10", "WINTER": "12"})
    return (
        F.when(s.rlike(iso) & day.isNotNull(), F.date_format(day, "yyyy-MM-dd"))
        .when(s.rlike(front), F.concat(_get(s, front, 2), F.lit("-Q"), _get(s, front, 1)))
        .when(s.rlike(back), F.concat(_get(s, back, 1), F.lit("-Q"), _get(s, back, 2)))
        .when(s.rlike("^[0-9]{4}-q[1-4]"), F.replace(s, F.lit("-q"), F.lit("-Q")))
        .when(s.rlike(season), F.concat(_get(s, season, 2), F.lit("-"), F.element_at(middle, F.upper(_get(s, season, 1)))))
        .otherwise(s)
    )


def contains_time(start: Column, end: Column, ts: Column) -> Column:
    """Whether the first day of a canonical time lies between two days, both included."""
    return time_start(ts).between(start, end)


def time_dim(spark: SparkSession, first: str, last: str) -> DataFrame:
    """All years, quarters, months and dates of a span of days: ``ts, level, start_date, end_date, parent_ts``."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    above = {"year": F.lit(None).cast("string"), "quarter": format_level(F.col("day"), "year"), "month": format_level(F.col("day"), "quarter"), "date": format_level(F.col("day"), "month")}
    rows = days.select(F.explode(F.array(*[F.struct(format_level(F.col("day"), lv).alias("ts"), F.lit(lv).alias("level"), up.alias("parent_ts")) for lv, up in above.items()])).alias("r")).select("r.*").distinct()
    return rows.select("ts", "level", time_start(F.col("ts")).alias("start_date"), time_end(F.col("ts")).alias("end_date"), "parent_ts")
