"""Chat formatting by schema fingerprints.

A record is a JSON object in some layout: rows with role and text, lists of messages, prompt and
completion, instruction with input and output, and so on.  The record's nested field paths are hashed, and
the hash selects a declarative mapping to canonical turns: the layout whose required paths the record has
all, by the number of its paths that the record has, then by place in the list.  A schema is resolved once and
remembered by its hash; fields that the layout doesn't know change nothing.

The template marks a turn as ``<|turn|>role\\ntext<|end|>\\n``.  Inside roles and texts a backslash is
doubled and each control string, of this template or of others, gets a backslash after its first
character, so no text can pose as markup and every text can be read back.  The loss mask covers the texts
of assistant turns.

Each turn is formatted by itself; a conversation is its turns in order.  Reading back streams a
conversation's turns in sorted order, so not even the longest one is held in memory.

Defined results: a null text or role is empty; turns go by turn (null last), then by their formatted string;
repeated rows are repeated turns; rows without conv_id are one conversation; a record in an unknown layout,
or that is no JSON object, has no turns but keeps its id; a very long text is one turn, formatted and read
whole, few turns at a time; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

#: Fixed strings of the template, and control strings of other public templates.
TURN, END = "<|turn|>", "<|end|>"
CONTROL = [
    TURN, END, "<s>", "</s>", "<pad>", "<unk>", "<bos>", "<eos>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "<|startoftext|>",
    "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<start_of_turn>", "<end_of_turn>",
]
LEARNED_ROLE = "assistant"

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_ROLE = re.compile(r"(?:[^\\\n]|\\.)*", re.DOTALL)


class Part(NamedTuple):
    """Turns of a mapping: role (a path, or '=' and the role itself) and text path, for each item of ``each``."""

    role: str
    text: str
    each: str = ""
    optional: bool = False


class Layout(NamedTuple):
    name: str
    required: frozenset
    known: frozenset
    parts: tuple


def _layout(name: str, *parts: Part) -> Layout:
    required, known = set(), set()
    for p in parts:
        inside = f"{p.each}[]." if p.each else ""
        paths = {inside + x for x in (p.role, p.text) if not x.startswith("=")}
        known |= paths
        required |= set() if p.optional else paths
    return Layout(name, frozenset(required), frozenset(known), parts)


_SYSTEM = Part("=system", "system", "", True)
LAYOUTS = [
    _layout("messages", _SYSTEM, Part("role", "content", "messages")),
    _layout("from_value", _SYSTEM, Part("from", "value", "conversations")),
    _layout("turns", _SYSTEM, Part("role", "text", "turns")),
    _layout("prompt_messages", _SYSTEM, Part("role", "content", "prompt"), Part("=assistant", "completion")),
    _layout("prompt_completion", _SYSTEM, Part("=user", "prompt"), Part("=assistant", "completion")),
    _layout("prompt_response", _SYSTEM, Part("=user", "prompt"), Part("=assistant", "response")),
    _layout("question_answer", _SYSTEM, Part("=user", "question"), Part("=assistant", "answer")),
    _layout("instruction_output", _SYSTEM, Part("=user", "instruction"), Part("=user", "input", "", True), Part("=assistant", "output")),
    _layout("instruction_response", _SYSTEM, Part("=user", "instruction"), Part("=user", "input", "", True), Part("=assistant", "response")),
    _layout("turn_rows", Part("role", "text")),
    _layout("role_content", Part("role", "content")),
]
#: Other names of the canonical roles, in the layouts that use them.
ROLE_NAMES = {"from_value": {"human": "user", "gpt": "assistant", "chatgpt": "assistant", "bot": "assistant"}}
#: Schemas whose layout is remembered.
MOST_SCHEMAS = 10_000


def field_paths(value, path: str = "") -> set[str]:
    """The paths of a JSON value's fields: names joined by dots, [] for the items of a list."""
    if isinstance(value, dict):
        return {path}.union(*(field_paths(v, f"{path}.{k}" if path else k) for k, v in value.items())) - {""}
    if isinstance(value, list):
        return {path}.union(*(field_paths(v, f"{path}[]") for v in value))
    return {path}


def _hash(paths) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)))


def fingerprint(record) -> int:
    return _hash(field_paths(record))


_LAYOUT_OF: dict[int, Layout | None] = {}


def layout_of(record) -> Layout | None:
    """The layout that the record's fingerprint selects, None where none has all its required paths."""
    paths = field_paths(record)
    key = _hash(paths)
    if key not in _LAYOUT_OF:
        if len(_LAYOUT_OF) >= MOST_SCHEMAS:
            _LAYOUT_OF.clear()
        fitting = [x for x in LAYOUTS if x.required <= paths]
        _LAYOUT_OF[key] = max(fitting, key=lambda x: len(x.known & paths), default=None)
    return _LAYOUT_OF[key]


def as_text(value) -> str:
    """A field as text: parts of a list are joined, by their text where they have one; others are JSON."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list) and value and all(isinstance(x, str) or isinstance(x, dict) and isinstance(x.get("text"), str) for x in value):
        return "".join(x if isinstance(x, str) else x["text"] for x in value)
    return json.dumps(value, ensure_ascii=False)


def turns_of(record) -> tuple[str | None, list[tuple[str, str]]]:
    """(layout name, canonical turns) of a record."""
    layout = layout_of(record) if isinstance(record, dict) else None
    if layout is None:
        return None, []
    names, out = ROLE_NAMES.get(layout.name, {}), []
    for part in layout.parts:
        items = record[part.each] if part.each else [record]
        for item in items if isinstance(items, list) else []:
            if not isinstance(item, dict):
                continue
            role = part.role[1:] if part.role.startswith("=") else as_text(item.get(part.role))
            text = as_text(item.get(part.text))
            if text or not part.optional:
                out.append((names.get(role, role), text))
    return layout.name, out


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """(a turn in the template, start and end of its loss mask in code points; equal where nothing is learned)."""
    head = f"{TURN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
    body = escape(text)
    learned = len(body) if role == LEARNED_ROLE else 0
    return f"{head}{body}{END}\n", len(head), len(head) + learned


def parsed(turn: str) -> tuple[str, str]:
    """(role, text) read back from a turn in the template."""
    role = _ROLE.match(turn, len(TURN))
    if not turn.startswith(TURN) or not turn.endswith(END + "\n") or turn[role.end() : role.end() + 1] != "\n":
        raise ValueError("not a turn of this template")
    return unescape(role[0]), unescape(turn[role.end() + 1 : -len(END) - 1])


FORMATTED = "conv_id long, turn long, part int, layout string, formatted string, loss_start int, loss_end int"


def format_records(records: DataFrame) -> DataFrame:
    """Turns in the template from records (conv_id long, turn long, payload string), one row for each turn.

    ``turn`` orders the records of a conversation, ``part`` the turns of a record; a record without turns
    gives one row without ``formatted``.
    """

    names = [x.strip().split(" ")[0] for x in FORMATTED.split(",")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for conv, turn, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
            try:
                layout, turns = turns_of(json.loads(payload or ""))
            except (ValueError, RecursionError):
                layout, turns = None, []
            rows += [(conv, turn, i, layout, *formatted(*t)) for i, t in enumerate(turns)] or [(conv, turn, 0, layout, None, 0, 0)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    return map_slices(records.select("conv_id", "turn", "payload"), work, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted turns and their loss masks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split(" ")[0] for x in DIGEST.split(",")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        now, state, done = None, None, []
        close = lambda: done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        for batch in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            for conv, turn, start, end in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if state is None or conv != now:
                    if state:
                        close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if turn is None:
                    continue
                role, text = parsed(turn)
                learned = unescape(turn[start:end])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(turn)
            if len(done) >= 4096:
                yield pack(done)
                done = []
        if state:
            close()
        if done:
            yield pack(done)

    slim = turns.select("conv_id", "turn", "part", "formatted", "loss_start", "loss_end").repartition("conv_id")
    return slim.sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "part", "formatted").mapInArrow(run, DIGEST)


def turn_rows(rows: DataFrame) -> DataFrame:
    """Records of the layout ``turn_rows`` from a table with a row for each turn."""
    payload = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), payload.alias("payload"))


def _escaped_sql(x: str) -> str:
    out = f"replace({x}, chr(92), repeat(chr(92), 2))"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


#: The rows of op3 in DuckDB SQL.
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length({_escaped_sql("r")}) + length(r) - length(replace(r, chr(10), '')) + length({_escaped_sql("t")}) + {len(TURN) + len(END) + 2} AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS LAST, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS LAST, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
