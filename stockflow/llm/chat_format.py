"""Chat formatting by schema fingerprints.

A record is a JSON object. The hash of its sorted nested field paths picks a declared mapping,
which turns prompt, instruction and message layouts into the same canonical turns. Turns become
one text in a template whose marks are control strings; control strings inside texts are
escaped, reversibly, and spans mark the assistant's words for the loss.

Escape: backslashes are doubled, then one backslash goes between the first character of a
control string and its rest. Doubled backslashes stand in even runs, so a single one there can
only be an escape, and undoing both steps in reverse order gives the text back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stockflow.llm.common import ship

Turn = tuple[str, str]

#: Marks of this template, and control strings of common others that must not occur raw.
CONTROL = [
    "<|turn|>", "<|says|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
]
_CONTROL = re.compile("|".join(f"(?<={re.escape(c[0])}){re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?={re.escape(c[1:])})" for c in CONTROL))
_MARKED = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>", re.DOTALL)


# Layouts


@dataclass(frozen=True)
class Layout:
    """Fields of single turns in order, or an array of messages with a role and a text field."""

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()  # (role, fields whose texts are joined by a line break)
    array: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict, hash=False)
    system: str = ""
    ignored: tuple[str, ...] = ()

    def paths(self) -> Iterator[list[str]]:
        """The sets of paths that this layout covers."""
        if self.array:
            inner = [[f"{self.array}[].{self.role}", f"{self.array}[].{self.text}"], [f"{self.array}[]"]]
        else:
            inner = [[f for _, fields in self.turns for f in fields]]
        for paths in inner:
            for system in [[], [self.system]] if self.system else [[]]:
                for ignored in [[], list(self.ignored)] if self.ignored else [[]]:
                    yield paths + system + ignored


LAYOUTS = [
    Layout("messages", array="messages", role="role", text="content", system="system", ignored=("id",)),
    Layout("shared", array="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}, system="system", ignored=("id",)),
    Layout("prompt", (("user", ("prompt",)), ("assistant", ("completion",))), system="system", ignored=("id",)),
    Layout("response", (("user", ("prompt",)), ("assistant", ("response",))), system="system", ignored=("id",)),
    Layout("instruction", (("user", ("instruction",)), ("assistant", ("output",))), system="system", ignored=("id",)),
    Layout("instruction_input", (("user", ("instruction", "input")), ("assistant", ("output",))), system="system", ignored=("id",)),
    Layout("question", (("user", ("question",)), ("assistant", ("answer",))), system="system", ignored=("id",)),
]


def field_paths(value: object, path: str = "") -> set[str]:
    """Paths of all leaves; an array adds ``[]``, and an empty one is a leaf."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{path}.{k}" if path else str(k)) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, path + "[]") for v in value))
    return {path + "[]" if isinstance(value, list) else path}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(set(paths))).encode(), digest_size=8).hexdigest()


def mapping_table(layouts: Iterable[Layout] = LAYOUTS) -> dict[str, Layout]:
    return {fingerprint(paths): layout for layout in layouts for paths in layout.paths()}


def _text(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def canonical(record: dict, layout: Layout) -> list[Turn]:
    turns = [("system", _text(record[layout.system]))] if layout.system in record else []
    if layout.array:
        for message in record[layout.array]:
            role = _text(message.get(layout.role))
            turns.append((layout.roles.get(role, role), _text(message.get(layout.text))))
    for role, fields in layout.turns:
        turns.append((role, "\n".join(_text(record[f]) for f in fields)))
    return turns


# Template


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text).replace("\\\\", "\\")


def format_turns(turns: list[Turn], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans (code points) under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|turn|>{escape(role)}<|says|>", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "<|end|>"]
        at += len(head) + len(body) + len("<|end|>")
    return "".join(parts), spans


def read_turns(formatted: str) -> list[Turn]:
    return [(unescape(role), unescape(text)) for role, text in _MARKED.findall(formatted)]


def read_loss(formatted: str, spans: Iterable[tuple[int, int]]) -> str:
    return "".join(unescape(formatted[a:b]) for a, b in spans)


# Tables

_TURNS = "array<struct<role:string,text:string>>"
_SPANS = "array<struct<begin:long,end:long>>"
_TURN_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_SPAN_TYPE = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
ADDED = ["fingerprint", "layout", "turns", "formatted", "loss_spans"]


def _format(batches: Iterator[pa.RecordBatch], record: str, keep: list[str], layouts: list[Layout]) -> Iterator[pa.RecordBatch]:
    table = mapping_table(layouts)
    for batch in batches:
        marks, names, turns, texts, spans = [], [], [], [], []
        for value in batch.column(record).to_pylist():
            try:
                parsed = json.loads(value) if value is not None else None
            except ValueError:
                parsed = None
            mark = fingerprint(field_paths(parsed)) if isinstance(parsed, dict) else None
            layout = table.get(mark)
            found = canonical(parsed, layout) if layout else None
            text, loss = format_turns(found) if found is not None else (None, None)
            marks.append(mark)
            names.append(layout.name if layout else None)
            turns.append([{"role": r, "text": t} for r, t in found] if found is not None else None)
            texts.append(text)
            spans.append([{"begin": a, "end": b} for a, b in loss] if loss is not None else None)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in keep),
                pa.array(marks, pa.string()),
                pa.array(names, pa.string()),
                pa.array(turns, _TURN_TYPE),
                pa.array(texts, pa.string()),
                pa.array(spans, _SPAN_TYPE),
            ],
            [*keep, *ADDED],
        )


def _schema(df: DataFrame, keep: list[str], added: str) -> StructType:
    return StructType([*(df.schema[c] for c in keep), *StructType.fromDDL(added).fields])


def format_records(
    records: DataFrame, record: str = "record", keep: list[str] | None = None, layouts: list[Layout] = LAYOUTS
) -> DataFrame:
    """Each row with fingerprint, layout, turns, formatted and loss_spans of its JSON record.

    A record that is null, no JSON object or of no declared layout has null turns and stays;
    null texts inside a known layout are empty. ``keep`` names the input columns that stay, all
    by default; those that clash with a new column give way.
    """
    ship(records.sparkSession)
    keep = [c for c in (records.columns if keep is None else keep) if c not in ADDED]
    wanted = list(dict.fromkeys([*keep, record]))
    added = f"fingerprint string, layout string, turns {_TURNS}, formatted string, loss_spans {_SPANS}"
    return records.select(*wanted).mapInArrow(
        lambda batches: _format(batches, record, keep, layouts), _schema(records, keep, added)
    )


def _digest(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for batch in batches:
        rows = []
        both = zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True)
        for formatted, spans in both:
            turns = read_turns(formatted or "")
            loss = read_loss(formatted or "", [(s["begin"], s["end"]) for s in spans or []])
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((len(turns), sha(said), len(loss), sha(loss), len(formatted or "")))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            [*keep, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def read_back(formatted: DataFrame, keep: list[str]) -> DataFrame:
    """Digests of turns and of the text under the loss mask, from the formatted text and spans alone."""
    added = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    slim = formatted.select(*keep, "formatted", "loss_spans")
    return slim.mapInArrow(lambda batches: _digest(batches, keep), _schema(formatted, keep, added))


def message_records(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows by turn as one JSON record per conversation, in the messages layout.

    Turns go in order of their number, those without one first; equal numbers by role and text.
    A null role or text is empty. A row without a conversation id is a conversation of its own,
    so any number of them may lack it. A conversation is one record, so it must fit a task;
    copies of a conversation under other ids are apart.
    """
    message = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
    known = F.col(conversation).isNotNull()
    gathered = rows.where(known).groupBy(conversation).agg(F.sort_array(F.collect_list(message)).alias("m"))
    gathered = gathered.unionByName(rows.where(~known).select(conversation, F.array(message).alias("m")))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return gathered.select(conversation, F.to_json(F.struct(messages.alias("messages"))).alias("record"))
