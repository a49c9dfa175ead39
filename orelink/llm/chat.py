"""Transcript parsing: a hidden Markov model over line features recovers roles, then turns are rendered.

A transcript is text whose turns may stand behind speaker markers of any style, or behind none. Each line is
seen as three features: the speaker class of a marker at its start, whether it follows a blank line, and a
length class. The hidden state is a role and whether the line begins a turn. Start, transition and emission counts
come from transcripts with known turns, smoothed by ``SMOOTHING``; Viterbi gives the best state path of a whole
transcript. A marker is then stripped where its speaker is the role of the line that it begins, lines of a turn are joined,
and turns rendered in one canonical form.

Whole conversations: turns are sorted by range over (conversation, turn, role, beginning and hash of the text) and dealt out in pieces of at most ``PIECE``
turns or ``PIECE_CHARS`` characters (or one turn). A piece is no transcript of its own: for each pair of states before and at its end
a matrix holds the score of the best path between them. These matrices combine by sums and maxima, first within a
sorted partition, then over the partitions that a conversation spans; the best states at the borders follow, and
each piece is decoded between its own. So the path has the score of the best path over the whole conversation, however long.
The renderings of a conversation's pieces, joined in the order of ``piece``, are its rendering.

Scale: neither a long conversation nor a hot key makes one large row or group: a group is one conversation in one sorted partition
(rows of one matrix a piece), then one row for each partition that it spans. Counting is one pass with at most a few
hundred sums; parsing is narrow.

Defined cases: null texts are empty; a null role in training is 'user'; unknown roles count as 'assistant'; null
turns come first in order; null ids form one conversation; rows that repeat are turns that repeat, in the order of turn, role
and the text's first 32 characters, then of a hash of it; a turn of any length is one row; empty tables give no rows; other columns are ignored. Blank
lines at the edges of a turn are dropped, of a turn that spans pieces at the edges of its parts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelink.llm.common import dropped, written

ROLES = ("system", "user", "assistant")
PIECE = 64
PIECE_CHARS = 1_000_000
SMOOTHING = 0.5
FOLDS = 4

# Names that markers use for each role, and the marker styles that transcripts are written in.
NAMES = {"system": ("system", "instruction", "context", "s"), "user": ("user", "human", "customer", "question", "q"), "assistant": ("assistant", "bot", "ai", "response", "answer", "a")}
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### Instruction:\n", "user": "### Human:\n", "assistant": "### Response:\n"},
    {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"},
    {"system": "[CONTEXT] ", "user": "[CUSTOMER] ", "assistant": "[BOT] "},
    {"system": "S: ", "user": "Q: ", "assistant": "A: "},
    {"system": "\n", "user": "\n", "assistant": "\n"},
)
_SPEAKER = {name: role for role, names in NAMES.items() for name in names}
_MARKER = re.compile(r"^\s*(?:[#*>]{1,4}\s*|<\|?|\[)?(" + "|".join(sorted(_SPEAKER, key=len, reverse=True)) + r")(?:\s*:|\|?>|\])\s*", re.I)
_SIZES = (1, 30, 80, 160, 320)

N_STATES = 2 * len(ROLES)  # state = 2 * role + (0 begins a turn, 1 goes on)
N_MARKS, N_BLANK, N_SIZES = len(ROLES) + 1, 2, len(_SIZES) + 1
N_SEEN = N_MARKS * N_BLANK * N_SIZES


def line_feature(line: str, before: str | None) -> int:
    m = _MARKER.match(line)
    mark = 1 + ROLES.index(_SPEAKER[m[1].lower()]) if m else 0
    blank = int(before is not None and not before.strip())
    return (mark * N_BLANK + blank) * N_SIZES + int(np.searchsorted(_SIZES, len(line), side="right"))


def features(text: str, before: str | None = None) -> tuple[list[str], list[int]]:
    """The lines and what is seen of each; ``before`` is the line ahead of the text."""
    lines = text.split("\n")
    return lines, [line_feature(x, lines[i - 1] if i else before) for i, x in enumerate(lines)]


def styled(turns: list[dict], style: int) -> tuple[str, list[int]]:
    """A transcript of the turns in one marker style, and the state of each of its lines."""
    parts, states = [], []
    for t in turns:
        role = t["role"] if t["role"] in ROLES else "assistant" if t["role"] else "user"
        part = STYLES[style][role] + (t["text"] or "")
        parts.append(part)
        states += [2 * ROLES.index(role) + (k > 0) for k in range(part.count("\n") + 1)]
    return "\n".join(parts), states


class Model:
    """Log start, transition and emission tables."""

    def __init__(self, counts: dict[tuple[str, int, int], int]):
        start, step, seen = np.full((1, N_STATES), SMOOTHING), np.full((N_STATES, N_STATES), SMOOTHING), np.full((N_STATES, N_SEEN), SMOOTHING / 10)
        for (kind, a, b), n in counts.items():
            {"start": start, "step": step, "seen": seen}[kind][a, b] += n
        for s in range(N_STATES):
            for t in range(N_STATES):
                if t % 2 and t // 2 != s // 2:
                    step[s, t] = 0  # a line that goes on keeps the role
        start[:, 1::2] = 0
        with np.errstate(divide="ignore"):
            self.start, self.step, self.seen = (np.log(x / x.sum(axis=1, keepdims=True)) for x in (start, step, seen))

    def entry(self, before: int | None) -> np.ndarray:
        """Scores of the states of a first line: of a transcript, or after a line of state ``before``."""
        return self.start[0] if before is None else self.step[before]

    def viterbi(self, seen: list[int], before: int | None = None, last: int | None = None) -> list[int]:
        """The best states of the lines, after state ``before`` and with ``last`` at the end where these are given."""
        best, back = self.entry(before) + self.seen[:, seen[0]], np.zeros((len(seen), N_STATES), np.int8)
        for i, x in enumerate(seen[1:], 1):
            ways = best[:, None] + self.step
            back[i] = ways.argmax(axis=0)
            best = ways.max(axis=0) + self.seen[:, x]
        path = [int(best.argmax()) if last is None else last]
        for b in back[:0:-1]:
            path.append(int(b[path[-1]]))
        return path[::-1]

    def matrix(self, seen: list[int]) -> np.ndarray:
        """Scores of the best paths over the lines: from the start (row 0) or from each state before (rows 1 on) to each state of the last."""
        best = np.concatenate([self.start, self.step]) + self.seen[:, seen[0]]
        for x in seen[1:]:
            best = (best[:, :, None] + self.step).max(axis=1) + self.seen[:, x]
        return best

    def turns(self, lines: list[str], path: list[int]) -> list[tuple[str | None, str]]:
        """(role, text) of each turn; markers and blank edges stripped. The role of lines that go on with an earlier turn is None."""
        turns: list[tuple[str | None, list[str]]] = []
        for line, state in zip(lines, path):
            if state % 2 == 0:
                m = _MARKER.match(line)
                own = m and ROLES.index(_SPEAKER[m[1].lower()]) == state // 2
                turns.append((ROLES[state // 2], [line[m.end() :] if own else line]))
            elif turns:
                turns[-1][1].append(line)
            else:
                turns.append((None, [line]))
        return [(role, "\n".join(x).strip("\n")) for role, x in turns]

    def parse(self, text: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a whole transcript."""
        lines, seen = features(text)
        return self.turns(lines, self.viterbi(seen))


_MARK = re.compile(r"^(\\*<\|(?:end|" + "|".join(ROLES) + r")\|>)$", re.M)
_ESCAPED = re.compile(r"^\\(\\*<\|(?:end|" + "|".join(ROLES) + r")\|>)$", re.M)


def rendered(turns: list[tuple[str | None, str]], first: bool = True, last: bool = True) -> str:
    """The canonical form; a part that goes on leaves its last turn open, and a part that follows closes the one before.

    A line of a turn that reads like a mark of this form gets a backslash more, so no text can end its turn or begin another.
    """
    out = []
    for k, (role, text) in enumerate(turns):
        close, text = "" if first and not k else "\n<|end|>\n", _MARK.sub(r"\\\1", text)
        out.append(f"{close}<|{role}|>\n{text}" if role else f"\n{text}")
    return "".join(out) + ("\n<|end|>\n" if last else "")


def reread(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendering of a whole conversation."""
    out, role, lines = [], None, []
    for line in text.split("\n"):
        if role is None:
            role = line[2:-2] if line else None  # nothing but the end follows the last mark
        elif line == "<|end|>":
            out.append((role, _ESCAPED.sub(r"\1", "\n".join(lines))))
            role, lines = None, []
        else:
            lines.append(line)
    return out


PIECES = "conv_id long, part int, piece long, turns array<struct<turn long, role string, text string>>, blank boolean, first boolean, last boolean"


def _dealt(batches: Iterator[pa.RecordBatch], most: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns as pieces; ``blank``: the line before is blank, null where it is not known; ``first``, ``last`` likewise of the conversation."""
    kind = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    held, size, done, out = [], 0, 0, []
    key, first, blank, part = None, None, None, 0  # of the conversation at hand; first and blank are null at the partition's edge

    def close(last):
        nonlocal held, size, done, first, blank
        out.append((key, part, part << 40 | done, held, blank, first, last))
        blank = not (held[-1]["text"] or "").split("\n")[-1].strip()
        held, size, done, first = [], 0, done + 1, False

    def given():
        nonlocal out
        rows, out = out, []
        kinds = (pa.int64(), pa.int32(), pa.int64(), kind, pa.bool_(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], ["conv_id", "part", "piece", "turns", "blank", "first", "last"])

    started = False
    for b in batches:
        for r in b.to_pylist():
            part = r["part"]
            if started and r["conv_id"] != key:
                close(True)
                key, first, blank = r["conv_id"], True, False
            elif not started:
                key, started = r["conv_id"], True
            elif len(held) >= most or size + len(r["text"] or "") > chars:
                close(False)
            held.append({"turn": r["turn"], "role": r["role"], "text": r["text"]})
            size += len(r["text"] or "")
        yield given()
    if started:
        close(None)
        yield given()


def pieces(conversations: DataFrame, most: int = PIECE, chars: int = PIECE_CHARS) -> DataFrame:
    """(conv_id, part, piece, turns, ..): the ordered turns of each piece, as written."""
    rows = written(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"))  # the range sample reads them too
    order = ["conv_id", "turn", "role", F.substring("text", 1, 32), F.xxhash64("text"), "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(dealt.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part")).mapInArrow(lambda b: _dealt(b, most, chars), PIECES))
    # the partition's edges: whether a conversation goes on from the partition before or into the next
    ends = found.where("first is null or last is null").groupBy("conv_id").agg(F.min("piece").alias("_least"), F.max("piece").alias("_most"))
    named = ends.select(F.col("conv_id").alias("_id"), "_least", "_most")  # two conversations a partition at most
    known = found.join(named, found["conv_id"].eqNullSafe(named["_id"]), "left")
    first, last = F.coalesce("first", F.col("piece") == F.col("_least")), F.coalesce("last", F.col("piece") == F.col("_most"))
    done = written(known.select("conv_id", "part", "piece", "turns", F.when(first, False).otherwise(F.col("blank")).alias("blank"), first.alias("first"), last.alias("last")))
    dropped(rows, found)
    return done


def style_of(conv_id: int | None) -> int:
    return zlib.crc32(str(conv_id).encode()) % len(STYLES)


def _before(blank: bool | None, first: bool) -> str | None:
    """A line that stands for the one ahead of a piece."""
    return None if first else "" if blank else "x"


def fit(groups: DataFrame) -> Model:
    """A model from the pieces of conversations whose conv_id's crc32, divided by len(STYLES), is not 0 modulo FOLDS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for b in batches:
            for row in b.to_pylist():
                if held_out(row["conv_id"]):
                    continue
                text, states = styled(row["turns"], style_of(row["conv_id"]))
                _, seen = features(text, _before(row["blank"], row["first"]))
                if row["first"]:
                    sums["start", 0, states[0]] += 1
                sums.update(("step", s, t) for s, t in zip(states, states[1:]))
                sums.update(("seen", s, x) for s, x in zip(states, seen))
        kinds = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kinds], pa.string()), *(pa.array(x, pa.int64()) for x in ([k[1] for k in kinds], [k[2] for k in kinds], [sums[k] for k in kinds]))], ["kind", "a", "b", "n"])

    rows = groups.mapInArrow(count, "kind string, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Model({(r.kind, r.a, r.b): r.n for r in rows})


def held_out(conv_id: int | None) -> bool:
    return zlib.crc32(str(conv_id).encode()) // len(STYLES) % FOLDS == 0


def parse_transcripts(transcripts: DataFrame, model: Model) -> DataFrame:
    """(id, turn, role, text) of each turn of each transcript (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["id"], k, role, text) for r in b.to_pylist() for k, (role, text) in enumerate(model.parse(r["text"] or ""))]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["id", "turn", "role", "text"])

    return transcripts.select("id", "text").mapInArrow(run, "id long, turn long, role string, text string")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best path scores over two stretches; ``a`` may be of a first stretch (its row 0 counts) or a later one."""
    return (a[:, :, None] + b[None, 1:, :]).max(axis=1)


def _border_states(matrices: list[np.ndarray], before: int | None, last: int | None) -> list[int]:
    """The states at the ends of successive stretches on the best path, after ``before`` and up to ``last`` where given."""
    best, back = matrices[0][0 if before is None else 1 + before], []
    for m in matrices[1:]:
        ways = best[:, None] + m[1:]
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0)
    path = [int(best.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _matrix(values) -> np.ndarray:
    return np.array(values).reshape(N_STATES + 1, N_STATES)


def borders(groups: DataFrame, model: Model) -> DataFrame:
    """(piece, before, last): the states around each piece of the conversations with more than one; before is null for the first."""
    several = groups.where("not (first and last)")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                _, seen = features(styled(r["turns"], style_of(r["conv_id"]))[0], _before(r["blank"], r["first"]))
                out.append(model.matrix(seen).reshape(-1))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), b.column("piece"), pa.array(out, pa.list_(pa.float64()))], ["conv_id", "part", "piece", "scores"])

    def combined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece")
        whole = reduce(_product, map(_matrix, rows["scores"]))
        return pd.DataFrame({"conv_id": [key[0]], "part": [key[1]], "scores": [whole.reshape(-1)]}).astype({"conv_id": "Int64"})

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        states = _border_states([_matrix(x) for x in rows["scores"]], None, None)
        return pd.DataFrame({"conv_id": rows["conv_id"], "part": rows["part"], "before": pd.array([None, *states[:-1]], "Int32"), "last": states})

    def decided(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows, before = left.sort_values("piece"), right["before"].iloc[0]
        before = None if pd.isna(before) else int(before)
        states = _border_states([_matrix(x) for x in rows["scores"]], before, int(right["last"].iloc[0]))
        return pd.DataFrame({"piece": rows["piece"], "before": pd.array([before, *states[:-1]], "Int32"), "last": states})

    scores = written(several.mapInArrow(scored, "conv_id long, part int, piece long, scores array<double>"))
    stretches = written(scores.groupBy("conv_id", "part").applyInPandas(combined, "conv_id long, part int, scores array<double>"))
    around = stretches.groupBy("conv_id").applyInPandas(joined, "conv_id long, part int, before int, last int")
    own = F.coalesce("conv_id", F.lit(0)), F.col("conv_id").isNull()  # no null among the keys
    keyed = lambda df: df.withColumns({"k": own[0], "none": own[1]}).drop("conv_id")
    found = written(keyed(scores).groupBy("k", "none", "part").cogroup(keyed(around).groupBy("k", "none", "part")).applyInPandas(decided, "piece long, before int, last int"))
    dropped(scores, stretches)
    return found


FORMATTED = "conv_id long, piece long, style int, held_out boolean, n_lines long, n_turns long, n_found long, n_right long, roles string, rendered string"


def format_conversations(groups: DataFrame, model: Model) -> DataFrame:
    """Write each conversation as a transcript in its style, parse the whole again and render it, one row for each piece.

    n_right counts the lines whose role is recovered, of n_lines; n_found turns begin in the piece, of n_turns.
    """
    states = borders(groups, model)
    named = groups.join(states.withColumnRenamed("last", "end"), "piece", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                style = style_of(r["conv_id"])
                text, states = styled(r["turns"], style)
                lines, seen = features(text, _before(r["blank"], r["first"]))
                path = model.viterbi(seen, r["before"], r["end"])
                turns = model.turns(lines, path)
                right = sum(s // 2 == p // 2 for s, p in zip(states, path))
                roles = [x for x, _ in turns if x]
                rows.append((r["conv_id"], r["piece"], style, held_out(r["conv_id"]), len(states), len(r["turns"]), len(roles), right, ",".join(roles), rendered(turns, r["first"], r["last"])))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 4, pa.string(), pa.string())
            names = [c.split()[0] for c in FORMATTED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 10, kinds)], names)

    return named.mapInArrow(run, FORMATTED)
