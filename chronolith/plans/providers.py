"""Model providers: what the engine calls for language and embeddings. The defaults are deterministic and offline."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

from .prompts import Prompts

_NAME = re.compile(r"\b([A-Z][a-z]{2,})\b")
_TIME = re.compile(r"\b((?:19|20)\d\d(?:-Q[1-4]|-\d\d(?:-\d\d)?)?|Q[1-4] (?:19|20)\d\d)\b")


def extract_records(prompt: str) -> str:
    """Records of a text: capitalised words are entities, neighbours in a sentence are related at its first time."""
    out = []
    for sentence in re.split(r"[.!?\n]+", prompt):
        names = list(dict.fromkeys(_NAME.findall(sentence)))[:4]
        found = _TIME.findall(sentence)
        time = found[0] if found else "UNKNOWN_TIME"
        out += [f'("entity"<|>{n}<|>CONCEPT<|>{sentence.strip()[:80]})' for n in names]
        out += [f'("relationship"<|>{time}<|>{a}<|>{b}<|>{sentence.strip()[:80]})' for a, b in zip(names, names[1:], strict=False)]
    return "##".join(out) + "<|COMPLETE|>"


def question_times(prompt: str) -> str:
    """Time constraints of a question, in the record grammar."""
    found = _TIME.findall(prompt)
    low = prompt.lower()
    if len(found) >= 2 and ("between" in low or "from" in low):
        return f'("entity"<|>between<|>{found[0]}<|>{found[1]}<|>date)<|COMPLETE|>'
    logic = "before" if "before" in low else "after" if "after" in low or "since" in low else "at"
    return "##".join(f'("entity"<|>{logic}<|>{t}<|>date)' for t in found) + "<|COMPLETE|>"


def question_granularity(prompt: str) -> str:
    """The level of a question's first time, in the record grammar; nothing where it has none."""
    found = _TIME.search(prompt)
    if not found:
        return "<|COMPLETE|>"
    time = found[1]
    level = "quarter" if "Q" in time else {4: "year", 7: "month"}.get(len(time), "date")
    return f'("granularity"<|>{level})<|COMPLETE|>'


def summarise(prompt: str) -> str:
    """The first words of the description."""
    return " ".join(prompt.replace("<SEP>", " ").split()[:60])


def write_report(prompt: str) -> str:
    lines = [x for x in prompt.split("\n") if x.strip()]
    return json.dumps({"title": lines[0][:60] if lines else "Empty", "summary": " ".join(lines[1:4])[:200], "rating": float(min(10, len(lines))), "rating_explanation": f"{len(lines)} lines", "findings": [{"summary": x[:40], "explanation": x[:120]} for x in lines[1:3]]})


def answer_points(prompt: str) -> str:
    lines = [x for x in prompt.split("\n") if x.strip()]
    return json.dumps({"points": [{"description": x[:120], "score": float(len(x) % 100)} for x in lines[:5]]})


def answer(prompt: str) -> str:
    return prompt.split("\n", 1)[0][:200] + " [" + hashlib.md5(prompt.encode()).hexdigest()[:8] + "]"


def embed(text: str, dims: int = 64) -> list[float]:
    """A unit vector of hashed words."""
    v = np.zeros(dims)
    for word in text.lower().split():
        h = hashlib.md5(word.encode()).digest()
        v[int.from_bytes(h[:4], "little") % dims] += 1 if h[4] % 2 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed_all(texts: Sequence[str]) -> list[list[float]]:
    return [embed(t) for t in texts]


#: Characters and records that a usable extraction has at least.
LEAST_CHARACTERS, LEAST_RECORDS = 10, 1


def usable(response: str | None) -> bool:
    """Whether an extraction is long enough and holds a record."""
    return response is not None and len(response) >= LEAST_CHARACTERS and response.count("<|>") >= 2 * LEAST_RECORDS


@dataclass
class Providers:
    """Functions from text to text or vectors; replace any of them by calls to a model of your own.

    ``extract`` is tried first, then ``extract_simple`` and ``extract_basic``, until an answer is usable. ``glean(text, found)``
    asks for what was missed, up to ``max_gleaning`` times, as long as ``more(text, found)`` says yes.
    """

    extract: Callable[[str], str] = extract_records
    extract_simple: Callable[[str], str] | None = None
    extract_basic: Callable[[str], str] | None = None
    glean: Callable[[str, str], str] | None = None
    more: Callable[[str, str], str] | None = None
    times: Callable[[str], str] = question_times
    granularity: Callable[[str], str] = question_granularity
    report: Callable[[str], str] = write_report
    community_report: Callable[[str], str] = write_report
    points: Callable[[str], str] = answer_points
    respond: Callable[[str], str] = answer
    reduce: Callable[[str], str] = answer
    naive: Callable[[str], str] = answer
    summarise: Callable[[str], str] = summarise
    alike: Callable[[str, str], float] | None = None
    embed: Callable[[str], list[float]] = embed
    embed_all: Callable[[Sequence[str]], list[list[float]]] | None = None
    embed_batch: int = 32
    retries: int = 3
    backoff: float = 0.0
    max_gleaning: int = 1
    fail_response: str = "Sorry, I'm not able to provide an answer to that question."

    def vectors(self, texts: Sequence[str]) -> list[list[float]]:
        """Embeddings, a batch of the model's size at a time."""
        if self.embed_all is None:
            return [self.embed(t) for t in texts]
        return [v for a in range(0, len(texts), self.embed_batch) for v in self.embed_all(list(texts[a : a + self.embed_batch]))]

    def records(self, text: str) -> str:
        """The extraction of a text: simpler prompts where an answer isn't usable, then what was missed; empty if all fail."""
        for attempt, fn in enumerate([self.extract, self.extract_simple or self.extract, self.extract_basic or self.extract]):
            if attempt:
                time.sleep(self.backoff * 2**attempt)
            try:
                found = fn(text)
            except Exception:  # noqa: BLE001  the next prompt is the answer to a failed one
                continue
            if self.glean is not None:
                for turn in range(self.max_gleaning):
                    try:
                        found += self.glean(text, found)
                        go_on = turn + 1 < self.max_gleaning and self.more is not None and self.more(text, found).strip("\"' \n").lower() == "yes"
                    except Exception:  # noqa: BLE001  what was found before stays
                        go_on = False
                    if not go_on:
                        break
            if usable(found):
                return found
        return ""

    def similarity(self, a: str, b: str) -> float:
        """How alike two relations are, by the model if there is one, else by their vectors."""
        if self.alike is not None:
            return min(1.0, max(0.0, float(self.alike(a, b))))
        x, y = (np.array(v) for v in self.vectors([a, b]))
        return float(max(0.0, x @ y / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-12)))


# ---------------------------------------------------------------- models by name

#: Dimensions of the embeddings of the kinds of providers (fixed values).
DIMENSIONS = {"openai": 1536, "azure": 1536, "bedrock": 1024, "gemini": 768, "ollama": 768}


def kind_of(model: str) -> str:
    """The kind of provider that a model's name speaks of."""
    low = model.lower()
    for kind, signs, starts in (("gemini", ("gemini",), ("google/",)), ("bedrock", ("claude", "anthropic"), ("us.",)), ("ollama", ("llama",), ("ollama/",))):
        if any(s in low for s in signs) or low.startswith(starts):
            return kind
    return "openai"


def messages(kind: str, *turns: str) -> list[dict]:
    """Turns, the user's first, as a kind of provider wants them."""
    pack = (lambda t: [{"text": t}]) if kind == "bedrock" else (lambda t: t)
    return [{"role": "assistant" if i % 2 else "user", "content": pack(t)} for i, t in enumerate(turns)]


@dataclass
class Model:
    """A text model behind ``send(kind, model, messages) -> text``: answers are cached by all arguments, failures tried again.

    The cache is any mapping; pass one that is shared and kept where answers must outlive a task.
    """

    name: str
    send: Callable[[str, str, list[dict]], str]
    kind: str = ""
    attempts: int = 5
    wait: tuple[float, float] = (4.0, 10.0)
    cache: dict[str, str] | None = field(default_factory=dict)
    hits: int = 0
    misses: int = 0

    def __post_init__(self) -> None:
        self.kind = self.kind or kind_of(self.name)
        if self.kind not in DIMENSIONS:
            raise ValueError(f"unknown provider {self.kind!r}")

    def __call__(self, *turns: str) -> str:
        packed = messages(self.kind, *turns)
        key = hashlib.md5(json.dumps([self.kind, self.name, packed]).encode()).hexdigest()
        if self.cache is not None and key in self.cache:
            self.hits += 1
            return self.cache[key]
        self.misses += 1
        for attempt in range(self.attempts):
            try:
                out = self.send(self.kind, self.name, packed)
                break
            except Exception:
                if attempt == self.attempts - 1:
                    raise
                time.sleep(min(self.wait[1], self.wait[0] * 2**attempt))
        if self.cache is not None:
            self.cache[key] = out
        return out


def prompted(model: Callable[..., str], prompts: Prompts | None = None, **others) -> Providers:  # noqa: ANN003
    """Providers that ask one text model by the prompts of a catalogue."""
    p = prompts or Prompts()
    ask = lambda key: lambda text: model(p.format(key, input_text=text))
    return Providers(
        extract=ask("extract"),
        extract_simple=ask("extract_simple"),
        extract_basic=ask("extract_basic"),
        glean=lambda text, found: model(p.format("extract", input_text=text), found, p.format("continue")),
        more=lambda text, found: model(p.format("extract", input_text=text), found, p.format("more")),
        times=ask("times"),
        granularity=ask("granularity"),
        report=ask("report"),
        community_report=ask("community_report"),
        points=ask("points"),
        respond=ask("local"),
        reduce=ask("reduce"),
        naive=ask("naive"),
        summarise=ask("summarise"),
        alike=lambda a, b: float(model(p.format("alike", input_text=f"{a}\n{b}"))),
        fail_response=p.format("fail"),
        **others,
    )


@dataclass
class QueryParam:
    """Parameters of a query; the numbers are the defaults of the modes."""

    mode: str = "local"
    level: int = 2
    top_k: int = 20
    only_context: bool = False
    min_rating: float = 0.0
    max_reports: int = 512
    local_tokens: int = 4000
    context_tokens: int = 6000
    report_tokens: int = 2000
    global_tokens: int = 16384
    naive_tokens: int = 12000
    granularity: str | None = None
    #: Where the first entities come from: ``relations`` that are like the question, or ``entities``.
    seeds: str = "relations"
    #: Pieces of evidence below which further ones are looked for.
    least_evidence: int = 4
