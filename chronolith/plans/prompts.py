"""Prompts: a catalogue of templates by name, read from a file or the built-in ones."""

from __future__ import annotations

import json
from pathlib import Path

#: What every template may name (the record grammar's delimiters).
GRAMMAR = {"tuple_delimiter": "<|>", "record_delimiter": "##", "completion_delimiter": "<|COMPLETE|>"}

_RECORDS = 'Write each record as ("entity"{tuple_delimiter}name{tuple_delimiter}type{tuple_delimiter}description) or ("relationship"{tuple_delimiter}time{tuple_delimiter}source{tuple_delimiter}target{tuple_delimiter}description), put {record_delimiter} between records and {completion_delimiter} at the end.'

DEFAULTS: dict[str, str] = {
    "extract": "List the entities of the text and the relations between them, each with the time it holds at (YYYY, YYYY-QN, YYYY-MM or YYYY-MM-DD). " + _RECORDS + "\n\nText:\n{input_text}",
    "extract_simple": "Name the entities and dated relations in this text. " + _RECORDS + "\n\n{input_text}",
    "extract_basic": "Who did what, and when? " + _RECORDS + "\n\n{input_text}",
    "continue": "Some were missed. Write the missing records in the same form.",
    "more": "Are there still records missing? Answer yes or no.",
    "plain_entities": 'List entities and undated relations. Write ("entity"{tuple_delimiter}name{tuple_delimiter}type{tuple_delimiter}description) or ("relationship"{tuple_delimiter}source{tuple_delimiter}target{tuple_delimiter}description{tuple_delimiter}strength), {record_delimiter} between them.\n\n{input_text}',
    "claims": "List the claims of the text. Write (subject{tuple_delimiter}object{tuple_delimiter}type{tuple_delimiter}status{tuple_delimiter}start{tuple_delimiter}end{tuple_delimiter}description{tuple_delimiter}quote), {record_delimiter} between them.\n\n{input_text}",
    "times": 'Which times does the question ask for? Write ("entity"{tuple_delimiter}at, before or after{tuple_delimiter}time{tuple_delimiter}level) or ("entity"{tuple_delimiter}between{tuple_delimiter}first{tuple_delimiter}last{tuple_delimiter}level).\n\n{input_text}',
    "granularity": 'At which level of time should the question be answered: year, quarter, month or date? Write ("granularity"{tuple_delimiter}level).\n\n{input_text}',
    "local": "Answer the question from the passages only.\n\n{input_text}",
    "points": 'Give the points of these reports that help to answer, as JSON {{"points": [{{"description": "..", "score": 0}}]}} with scores from 0 to 100.\n\n{input_text}',
    "reduce": "Answer the question from the analysts' points, the important ones first.\n\n{input_text}",
    "naive": "Answer the question from these passages.\n\n{input_text}",
    "fail": "Sorry, I'm not able to provide an answer to that question.",
    "report": 'Report on what happened at this time, as JSON with title, summary, rating (0 to 10), rating_explanation and findings (summary, explanation).\n\n{input_text}',
    "community_report": 'Report on this community of entities, as JSON with title, summary, rating (0 to 10), rating_explanation and findings (summary, explanation).\n\n{input_text}',
    "summarise": "Say the same in one paragraph, in the third person, without contradictions.\n\n{input_text}",
    "alike": "How alike are these two relations, from 0 to 1? Answer with the number.\n\n{input_text}",
}


def read_tree(path: str) -> dict:
    """A JSON file, or a YAML one where a reader of YAML is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.lower().endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package; JSON doesn't") from e
    return yaml.safe_load(text) or {}


class Prompts:
    """Templates by name. A file has them at its top or in sections (dicts), whose names don't matter; its own come before the
    built-in ones, and its values that aren't templates of ours may be named in templates."""

    def __init__(self, path: str | None = None, **own: str):
        self.templates, self.values = dict(DEFAULTS), dict(GRAMMAR)
        tree = read_tree(path) if path else {}
        for name, value in tree.items():
            for key, text in value.items() if isinstance(value, dict) else [(name, value)]:
                if key.lower() in GRAMMAR:
                    self.values[key.lower()] = str(text)
                elif isinstance(text, str):
                    self.templates[key] = text
        self.templates |= own

    def format(self, key: str, **values: str) -> str:
        """A template with its variables; one that lacks a variable is returned as it is."""
        if key not in self.templates:
            raise KeyError(f"no prompt {key!r}")
        try:
            return self.templates[key].format(**self.values, **values)
        except (KeyError, IndexError, ValueError):
            return self.templates[key]

    def valid(self, key: str) -> bool:
        return bool(str(self.templates.get(key) or "").strip())
