"""Speakers recovered from raw transcripts by a hidden Markov model, then turns rendered canonically.

A transcript is lines. A line shows features only: what its beginning looks like (a marker of one of the roles, some
other name with a colon, a dash, nothing), its length class, whether it asks. The hidden state is the speaking role and
whether a turn starts. Start, transition and emission tables are counted with smoothing on a bounded sample of labelled
lines (``SAMPLE`` conversations at most, by a hash of their ids); Viterbi gives the likeliest states.

A conversation may be of any size: it is cut into segments of ``SEGMENT`` rows, each reduced to a matrix of best scores
from state to state, of which max-plus products are taken; then every segment is decoded between its known ends, which
gives the very path that one pass would. No conversation is ever gathered as a whole.

Null texts are empty lines. Rows go by turn, then text; rows of one turn are one after another. A null id is the id of
one conversation, a null turn comes first. Extra columns are passed by; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_limits, map_arrow

ROLES = ("system", "user", "assistant")
#: A state is role * 2 + (0 if the turn starts with the line, 1 if it goes on).
STATES = 2 * len(ROLES)
SAMPLE, SAMPLE_ROWS, SAMPLE_CHARS, SMOOTH = 2_000, 40_000, 20_000_000, 0.5
#: Rows and characters of a segment, and matrices that are multiplied at a time.
SEGMENT, SEGMENT_CHARS, FAN = 512, 1 << 20, 512

#: Ways in which speakers are named at the start of a line (fixed values).
MARKERS = {"system": ("system", "instructions", "sys"), "user": ("user", "human", "question", "q", "me"), "assistant": ("assistant", "ai", "answer", "a", "bot")}
_WORDS = {w: r for r, ws in MARKERS.items() for w in ws}
_NAMED = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|\[|<\|?)?([A-Za-z]{1,14})(?:\*\*|\]|\|?>)?\s*(?::|>|\]|-\s)\s*(?:\*\*)?")
_BRACKET = re.compile(r"^\s*(?:\[|<\||\*\*)([A-Za-z]{1,14})(?:\]|\|>|\*\*)\s*:?\s*")
_DASH = re.compile(r"^\s*[-–—*>]\s+")

#: Marker classes: the roles, another name, a dash, none; length classes: empty, short, middle, long; asks or not.
N_MARKS, N_SIZES = len(ROLES) + 3, 4


def split_marker(line: str) -> tuple[int, str]:
    """(marker class, rest of the line)."""
    m = _BRACKET.match(line) or _NAMED.match(line)
    if m:
        role = _WORDS.get(m[1].lower())
        if role:
            return ROLES.index(role), line[m.end() :]
        return len(ROLES), line
    m = _DASH.match(line)
    if m:
        return len(ROLES) + 1, line[m.end() :]
    return len(ROLES) + 2, line


def observe(line: str) -> tuple[int, int, int]:
    mark, rest = split_marker(line)
    n = len(rest.strip())
    return mark, int(n > 0) + int(n > 40) + int(n > 160), int(rest.rstrip().endswith("?"))


class Hmm:
    """Log tables; ``emit[state, mark, size, asks]`` is a sum of three independent ones."""

    def __init__(self, start: np.ndarray, move: np.ndarray, marks: np.ndarray, sizes: np.ndarray, asks: np.ndarray):
        log = lambda t: np.log(t / t.sum(-1, keepdims=True))
        self.start, self.move, self.marks, self.sizes, self.asks = map(log, (start, move, marks, sizes, asks))

    def emissions(self, lines: list[str]) -> np.ndarray:
        seen = np.array([observe(x) for x in lines]).reshape(-1, 3)
        return (self.marks[:, seen[:, 0]] + self.sizes[:, seen[:, 1]] + self.asks[:, seen[:, 2]]).T

    def product(self, emit: np.ndarray, first: bool) -> np.ndarray:
        """Best score from the state before the lines to the state of the last; of a first segment all rows are alike."""
        best = np.broadcast_to(self.start + emit[0], (STATES, STATES)) if first else self.move + emit[0]
        for e in emit[1:]:
            best = (best[:, :, None] + self.move[None]).max(1) + e
        return best - best.max()  # what all paths have in common doesn't matter, and sums stay small

    def decode(self, emit: np.ndarray, before: int | None, last: int | None) -> np.ndarray:
        """The best states, after state ``before`` (None: the beginning) and with the last state given (None: any)."""
        score = (self.start if before is None else self.move[before]) + emit[0]
        back = np.zeros((len(emit), STATES), np.int8)
        for t in range(1, len(emit)):
            to = score[:, None] + self.move
            back[t] = to.argmax(0)
            score = to.max(0) + emit[t]
        path = np.zeros(len(emit), np.int64)
        path[-1] = score.argmax() if last is None else last
        for t in range(len(emit) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path


def fit(lines: list[tuple[object, str | None, bool, str]]) -> Hmm:
    """From (conversation, role, whether its turn starts, line), in order."""
    start, move = np.full(STATES, SMOOTH), np.full((STATES, STATES), SMOOTH)
    marks, sizes, asks = np.full((STATES, N_MARKS), SMOOTH), np.full((STATES, N_SIZES), SMOOTH), np.full((STATES, 2), SMOOTH)
    for s in range(STATES):  # a turn goes on in its own role only
        move[s, [t for t in range(1, STATES, 2) if t // 2 != s // 2]] = 1e-6
    start[1::2] = 1e-6
    before = None
    for conv, role, starts, line in lines:
        if role not in ROLES:
            continue
        state = ROLES.index(role) * 2 + (not starts)
        if before is None or before[0] != conv:
            start[state] += 1
        else:
            move[before[1], state] += 1
        mark, size, ask = observe(line)
        marks[state, mark] += 1
        sizes[state, size] += 1
        asks[state, ask] += 1
        before = (conv, state)
    return Hmm(start, move, marks, sizes, asks)


def render(states: np.ndarray, lines: list[str], begins: bool, ends: bool) -> str:
    """Lines as canonical turns; with ``begins`` and ``ends`` at the two ends of a conversation."""
    out = []
    for i, (state, line) in enumerate(zip(states.tolist(), lines, strict=True)):
        if state % 2 == 0 or (i == 0 and begins):
            out.append(("" if i == 0 and begins else "<|end|>\n") + f"<|{ROLES[state // 2]}|>\n")
        mark, rest = split_marker(line)
        out.append((rest if mark < len(ROLES) and state % 2 == 0 else line) + "\n")
    return "".join(out) + "<|end|>\n" * ends


def _lines(texts: list[str]) -> tuple[list[str], list[int]]:
    """All lines of the rows, and where each row's begin."""
    lines, at = [], []
    for t in texts:
        at.append(len(lines))
        lines += t.split("\n")
    return lines, at


def _segments(segment: int):
    """Rows (conv, conv_id, turn, text) in order to segments: (conv, part, number, final, rows), the task being the part.

    ``number`` counts the part's segments of the conversation, ``final`` marks the last of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, number, rows, chars, done, kind = None, 0, [], 0, [], None

        def close(final: bool) -> None:
            done.append((conv, part, number, final, list(rows)))
            rows.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if done:
                types = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(kind)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=["conv", "part", "number", "final", "rows"])
                done.clear()

        for batch in batches:
            kind = pa.struct([batch.schema.field(i) for i in (1, 2, 3)])
            for c, conv_id, turn, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    if rows:
                        close(True)
                    conv, number, chars = c, 0, 0
                elif len(rows) >= segment or chars >= SEGMENT_CHARS:
                    close(False)
                    number, chars = number + 1, 0
                rows.append({"conv_id": conv_id, "turn": turn, "text": text})
                chars += len(text)
            yield from flush()
        if rows:
            close(True)
        yield from flush()

    return run


MATRIX, ENDS = "conv string, number long, matrix array<double>", "conv string, number long, before int, last int"


def _matrices(hmm: Hmm):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for number, rows in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            lines, _ = _lines([r["text"] for r in rows.as_py()])
            out.append(hmm.product(hmm.emissions(lines), number == 0).ravel().tolist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=["conv", "number", "matrix"])

    return fn


def _stack(part: pd.DataFrame) -> np.ndarray:
    return np.stack([np.array(m).reshape(STATES, STATES) for m in part["matrix"]])


def _product(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("number")
    matrices = _stack(part)
    out = matrices[0]
    for m in matrices[1:]:
        out = (out[:, :, None] + m[None]).max(1)
        out -= out.max()
    return pd.DataFrame({"conv": part["conv"].iloc[:1], "number": part["up"].iloc[:1], "matrix": [out.ravel().tolist()]})


def _between(part: pd.DataFrame) -> pd.DataFrame:
    """States at the ends of neighbouring segments, after ``start`` (below 0: the beginning) and before ``stop`` (so too: any)."""
    part = part.sort_values("number")
    matrices, start, stop = _stack(part), int(part["start"].iloc[0]), int(part["stop"].iloc[0])
    score, back = matrices[0][max(start, 0)], []
    for m in matrices[1:]:
        to = score[:, None] + m
        back.append(to.argmax(0))
        score = to.max(0)
    ends = [int(score.argmax()) if stop < 0 else stop]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    return pd.DataFrame({"conv": part["conv"], "number": part["number"], "before": [start, *ends[:-1]], "last": ends})


def segment_ends(matrices: DataFrame, scratch: Scratch, fan: int = FAN, level: int = 0) -> DataFrame:
    """``(conv, number, before, last)``: the states before and at the end of each segment, of ``(conv, number, matrix)``."""
    grouped = matrices.withColumn("up", F.floor(F.col("number") / fan).cast("long"))
    if (matrices.agg(F.max("number")).first()[0] or 0) < fan:
        known = grouped.withColumns({"start": F.lit(-1), "stop": F.lit(-1)})
    else:
        above = scratch.save(grouped.groupBy("conv", "up").applyInPandas(_product, MATRIX), f"matrices-{level + 1}")
        ends = segment_ends(above, scratch, fan, level + 1).select("conv", F.col("number").alias("up"), F.col("before").alias("start"), F.col("last").alias("stop"))
        known = grouped.join(ends, ["conv", "up"])
    return scratch.save(known.groupBy("conv", "up").applyInPandas(_between, ENDS), f"ends-{level}")


def _render(hmm: Hmm):
    """Segments (begins, ends, before, last, rows) to their rows with roles and rendered parts."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        roles, turns, parts = [], [], []
        column = batch.column(4)
        rows = column.flatten()
        texts, at = rows.field("text").to_pylist(), np.diff(column.offsets.to_numpy())
        begin = 0
        for begins, ends, before, last, n in zip(*(batch.column(i).to_pylist() for i in range(4)), at.tolist(), strict=True):
            own = texts[begin : begin + n]
            begin += n
            lines, first = _lines(own)
            states = hmm.decode(hmm.emissions(lines), None if before is None or before < 0 else before, last)
            for i in range(n):
                a, b = first[i], first[i + 1] if i + 1 < n else len(lines)
                roles.append(ROLES[states[a] // 2])
                turns.append(int((states[a:b] % 2 == 0).sum()))
                parts.append(render(states[a:b], lines[a:b], begins and i == 0, ends and i == n - 1))
        arrays = [rows.field("conv_id"), rows.field("turn"), pa.array(roles, pa.string()), pa.array(turns, pa.int64()), pa.array(parts, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "turn", "role", "n_turns", "rendered"])

    return fn


def parse_transcripts(rows: DataFrame, hmm: Hmm, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """``(conv_id, turn, role, n_turns, rendered)`` for every row of ``rows(conv_id, turn, text)``.

    ``role``: of the row's first line; ``n_turns``: turns that start in the row; ``rendered``: the row's part of the
    canonical transcript, which is the parts' concatenation.
    """
    scratch = Scratch(rows.sparkSession, "transcripts")
    arrow_limits(rows.sparkSession)
    types = dict(rows.dtypes)
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = rows.select(conv.alias("conv"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.col("turn").try_cast("long").alias("o"))
    # equal rows of a turn may stand in several tasks: which input partition they come from tells them apart
    order = [F.col("conv"), F.asc_nulls_first("o"), F.xxhash64("text"), F.spark_partition_id()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order[:3], "text")
    schema = f"conv string, part int, number long, final boolean, rows array<struct<conv_id:{types['conv_id']},turn:{types['turn']},text:string>>"
    cut = scratch.save(rows.select("conv", "conv_id", "turn", "text").mapInArrow(_segments(segment), schema), "segments")

    # conversations that lie in several tasks: two a task at most, so the broadcast is bounded
    held = cut.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    whole, before = Window.partitionBy("conv"), Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.min("part").over(whole).alias("head"), F.max("part").over(whole).alias("tail"))
    cut = cut.join(F.broadcast(held.where("head < tail")), ["conv", "part"], "left")
    number = F.col("number") + F.coalesce("offset", F.lit(0))
    ends = F.col("final") & (F.col("part") == F.coalesce("tail", "part"))
    cut = cut.select("conv", number.alias("number"), (number == 0).alias("begins"), ends.alias("ends"), "rows")

    nothing = F.lit(None).cast("int")
    alone = cut.where("begins and ends").select("begins", "ends", nothing.alias("before"), nothing.alias("last"), "rows")
    many = cut.where("not (begins and ends)")
    known = segment_ends(scratch.save(map_arrow(many.select("conv", "number", "rows"), _matrices(hmm), MATRIX), "matrices"), scratch, fan)
    both = alone.unionByName(many.join(known, ["conv", "number"]).select(alone.columns))
    return map_arrow(both, _render(hmm), f"conv_id {types['conv_id']}, turn {types['turn']}, role string, n_turns long, rendered string")


# ---------------------------------------------------------------- raw transcripts of labelled conversations

#: Styles in which transcripts name their speakers: system, user, assistant.
STYLES = (("System: ", "User: ", "Assistant: "), ("[system] ", "[human] ", "[ai] "), ("### Instructions: ", "### Question: ", "### Answer: "), ("sys> ", "q> ", "a> "), ("**System**: ", "**Human**: ", "**AI**: "))


def raw_text() -> Column:
    """A turn as it would stand in a raw transcript: a marker in the conversation's style before it, one in eight without."""
    styles = F.array(*[F.create_map(*[F.lit(x) for kv in zip(ROLES, s, strict=True) for x in kv]) for s in STYLES])
    style = F.element_at(styles, F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int") + 1)
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0
    return F.concat(F.when(bare, "").otherwise(F.coalesce(F.element_at(style, F.col("role")), F.lit(""))), F.coalesce("text", F.lit("")))


def fit_sample(conversations: DataFrame) -> Hmm:
    """Tables from a bounded sample of conversations with their roles; see the module."""
    sizes = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    rows, chars, chosen = 0, 0, []
    for r in sizes.orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLE).collect():
        if rows + r.n <= SAMPLE_ROWS and chars + r.chars <= SAMPLE_CHARS:
            rows, chars = rows + r.n, chars + r.chars
            chosen.append(r.conv_id)
    some = conversations.where(F.col("conv_id").isin(chosen)).select("conv_id", "turn", "role", raw_text().alias("raw"))
    return fit([(r.conv_id, r.role, i == 0, line) for r in some.orderBy("conv_id", F.col("turn").try_cast("long"), "raw").collect() for i, line in enumerate(r.raw.split("\n"))])


def recover_roles(conversations: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """The raw transcripts of all conversations, parsed again."""
    hmm = fit_sample(conversations)
    return parse_transcripts(conversations.select("conv_id", "turn", raw_text().alias("text")), hmm, segment, fan)
