"""Text, key and JSON functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character references that occur in scraped text and what they stand for; the ampersand's comes last (fixed values).
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}

# Further character references of common names (fixed values).
NAMED = {"&copy;": "©", "&reg;": "®", "&trade;": "™", "&euro;": "€", "&pound;": "£", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&bull;": "•", "&eacute;": "é", "&uuml;": "ü", "&ouml;": "ö", "&auml;": "ä", "&szlig;": "ß"}

# Families of words and the phrase that a query with one of them gets (fixed values).
QUERY_FAMILIES = [
    (["earnings", "revenue", "profit", "loss", "growth", "decline", "quarter", "annual"], "financial performance metrics business data"),
    (["when", "time", "period", "year", "quarter", "month", "date"], "temporal information time period historical data"),
    (["company", "corporation", "inc", "ltd", "corp", "ceo", "executive"], "company organization business entity corporate information"),
    (["event", "announcement", "acquisition", "merger", "bankruptcy", "crisis"], "business events announcements corporate developments"),
]


def hash_id(content: Column, prefix: str = "") -> Column:
    """Key of a content: prefix and md5."""
    return F.concat(F.lit(prefix), F.md5(content.cast("binary")))


def args_hash(*columns: Column) -> Column:
    """md5 of the JSON of all arguments, in order."""
    return F.md5(F.to_json(F.struct(*[c.alias(f"a{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}).cast("binary"))


def clean_text(text: Column) -> Column:
    """Without white space at the ends, character references and control characters."""
    text = F.regexp_replace(text, "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", "")
    for reference, character in (NAMED | REFERENCES).items():
        text = F.replace(text, F.lit(reference), F.lit(character))
    return F.regexp_replace(text, "[\\x00-\\x1f\\x7f-\\x9f]", "")


def split_markers(text: Column, markers: list[str]) -> Column:
    """Parts between any of the markers, trimmed, without empty ones."""
    pattern = "|".join("\\Q" + m + "\\E" for m in markers)
    parts = F.transform(F.split(text, pattern), lambda x: F.regexp_replace(x, "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", ""))
    return F.filter(parts, lambda x: x != "")


def is_number(text: Column) -> Column:
    return text.rlike("^[-+]?[0-9]*\\.?[0-9]+$")


def quoted(text: Column) -> Column:
    """Numbers as they are, anything else in double quotes."""
    inner = F.regexp_replace(text, '^[" \\t]+|[" \\t]+$', "")
    return F.when(is_number(inner), inner).otherwise(F.concat(F.lit('"'), inner, F.lit('"')))


def csv_row(*columns: Column) -> Column:
    return F.concat_ws(",\t", *[quoted(c.cast("string")) for c in columns])


def sanitize(text: Column) -> Column:
    """An attribute without white space and quotes at its ends."""
    return F.regexp_replace(text, "^[ \\t\\r\\n\"']+|[ \\t\\r\\n\"']+$", "")


def tokens(text: Column) -> Column:
    """The default tokenizer: what stands between blanks, tabs and line ends."""
    return F.regexp_extract_all(text, F.lit("[^ \\t\\n\\r]+"), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def parse_value(text: Column) -> Column:
    """struct<kind, text, number, flag> of a scalar: null, a truth value, a whole or broken number, or a string."""
    t = F.btrim(text)
    low = F.lower(t)
    kind = (
        F.when(low.isin("null", "none", ""), "null")
        .when(low.isin("true", "false"), "bool")
        .when(t.rlike("^-?[0-9]+$"), "int")
        .when(t.rlike("^-?[0-9]*\\.[0-9]+$"), "float")
        .otherwise("string")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "string", F.regexp_replace(t, '^"|"$', "")).alias("text"),
        F.when(kind.isin("int", "float"), t.try_cast("double")).alias("number"),
        F.when(kind == "bool", low == "true").alias("flag"),
    )


def json_values(text: Column) -> Column:
    """map of keys to raw scalars found by pattern in anything that looks like JSON; later keys win."""
    pattern = '"([A-Za-z0-9_]+)"\\s*:\\s*("[^"]*"|-?[0-9.]+|true|false|null)'
    keys, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"].alias("k"), F.regexp_replace(x["v"], '^"|"$', "").alias("v"))))


def to_json_map(text: Column) -> Column:
    """map<string,string> of a response: strict JSON where it parses, else whatever pairs can be found in it."""
    body = F.regexp_extract(text, "(?s)(\\{.*\\})", 1)
    strict = F.from_json(body, "map<string,string>")
    good = strict.isNotNull() & (F.size(F.map_keys(strict)) > 0) & F.try_parse_json(body).isNotNull()
    return F.when(good, strict).otherwise(json_values(text))


def describe_map(descriptions: Column) -> Column:
    """``ts: text; ts: text`` of a map, by ts."""
    entries = F.array_sort(F.map_entries(descriptions))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def enhance_query(query: Column) -> Column:
    """The query with the phrases of every family of words that it uses."""
    added = [F.when(F.lower(query).rlike("|".join(words)), F.lit(phrase)) for words, phrase in QUERY_FAMILIES]
    return F.concat_ws(" ", query, *added)


def years_of(times: Column) -> Column:
    """Different years of an array of times, sorted."""
    years = F.transform(times, lambda t: F.regexp_extract(t, "([0-9]{4})", 1))
    return F.array_sort(F.array_distinct(F.filter(years, lambda y: y != "")))


def safe_id(text: Column) -> Column:
    """A name fit for paths and labels: letters, digits and underscores."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9_]+", "_")


def report_text(title: Column, summary: Column, findings: Column) -> Column:
    """Markdown of a report: title, summary, and a section for each finding."""
    sections = F.transform(findings, lambda f: F.concat(F.lit("## "), f["summary"], F.lit("\n\n"), f["explanation"]))
    return F.concat(F.lit("# "), title, F.lit("\n\n"), summary, F.lit("\n\n"), F.array_join(sections, "\n\n"))


def stored_attribute(value: Column, kind: str) -> Column:
    """An attribute as graph files hold it: nulls empty, maps, structs and arrays as JSON, anything else as text."""
    return F.coalesce(F.to_json(value) if kind.startswith(("map", "struct", "array")) else value.cast("string"), F.lit(""))


def restored_map(value: Column) -> Column:
    """A map that ``stored_attribute`` wrote; null for what is none."""
    return F.from_json(value, "map<string,string>")
