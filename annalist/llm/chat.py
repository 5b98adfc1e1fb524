"""Chat formatting: records of many layouts become canonical turns, and turns become templated text with a loss mask.

A record's layout is recognised by a fingerprint, the hash of its nested field paths; each fingerprint selects a
declarative mapping.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Layouts by name. paths: the field paths of a record. turns: a list's path with the fields of its role
#: and text; or pairs (role, path), where paths of one role are joined by an empty line. roles: canonical
#: names of the layout's own roles; without them a role stays as it is.
LAYOUTS = {
    "messages": {"paths": ["messages[].content", "messages[].role"], "turns": ("messages", "role", "content")},
    "conversations": {"paths": ["conversations[].from", "conversations[].value"], "turns": ("conversations", "from", "value"), "roles": ROLES},
    "dialogue": {"paths": ["data.turns[].speaker", "data.turns[].text"], "turns": ("data.turns", "speaker", "text"), "roles": ROLES},
    "system_messages": {"paths": ["messages[].content", "messages[].role", "system"], "pairs": [("system", "system")], "turns": ("messages", "role", "content")},
    "instruction": {"paths": ["instruction", "output"], "pairs": [("user", "instruction"), ("assistant", "output")]},
    "instruction_input": {"paths": ["input", "instruction", "output"], "pairs": [("user", "instruction"), ("user", "input"), ("assistant", "output")]},
    "prompt_completion": {"paths": ["completion", "prompt"], "pairs": [("user", "prompt"), ("assistant", "completion")]},
    "prompt_response": {"paths": ["prompt", "response"], "pairs": [("user", "prompt"), ("assistant", "response")]},
    "system_prompt_response": {"paths": ["prompt", "response", "system"], "pairs": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    "question_answer": {"paths": ["answer", "question"], "pairs": [("user", "question"), ("assistant", "answer")]},
}
START, END = "<|im_start|>", "<|im_end|>"


def field_paths(value, prefix: str = "") -> set[str]:
    """The paths of all leaves; lists add [] and contribute the union of what their items have."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else {prefix + "{}"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, prefix + "[]") for v in value)) if value else {prefix + "[]"}
    return {prefix}


def fingerprint(paths) -> str:
    """Hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def mappings(layouts: dict = LAYOUTS) -> dict[str, str]:
    """Layout name by fingerprint; a list layout also answers for its empty list."""
    out = {fingerprint(v["paths"]): k for k, v in layouts.items()}
    for name, v in layouts.items():
        if "turns" in v:
            at = v["turns"][0] + "[]"
            out.setdefault(fingerprint({at} | {p for p in v["paths"] if not p.startswith(at)}), name)
    return out


def _at(record, path: str):
    for k in path.split("."):
        record = record.get(k) if isinstance(record, dict) else None
    return record


def _string(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def canonical_turns(record, layout: dict) -> list[tuple[str, str]]:
    """(role, text) by a layout's mapping."""
    turns: list[tuple[str, str]] = []
    for role, path in layout.get("pairs", []):
        text = _string(_at(record, path))
        if turns and turns[-1][0] == role:
            text = f"{turns[-1][1]}\n\n{text}" if text else turns[-1][1]
            turns.pop()
        turns.append((role, text))
    if "turns" in layout:
        path, role, text = layout["turns"]
        names = layout.get("roles", {})
        turns += [(names.get(r := _string(m.get(role)), r), _string(m.get(text))) for m in _at(record, path) or [] if isinstance(m, dict)]
    return turns


def canonical(records: DataFrame, key: str, body: str, layouts: dict = LAYOUTS) -> DataFrame:
    """Records (JSON in column body) as (key, layout, fingerprint, turns array<struct<role, text>>).

    A record of no known layout has layout null and no turns, as have a null and malformed JSON (fingerprint null); it
    stays in the result, to be counted and mapped. Nulls inside a record read as empty texts. Rows are independent, so
    repeated rows give repeated results, and other columns of records don't matter.
    """
    known = mappings(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                try:
                    record = json.loads(text) if text is not None else None
                except ValueError:
                    record = None
                print_ = None if record is None else fingerprint(field_paths(record))
                name = known.get(print_)
                turns = canonical_turns(record, layouts[name]) if name else []
                out.append((name, print_, [{"role": r, "text": t} for r, t in turns]))
            cols = [pa.array(x, t) for x, t in zip(zip(*out) if out else [[], [], []], (pa.string(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["key", "layout", "fingerprint", "turns"])

    kind = records.schema[key].dataType.simpleString()
    return records.select(F.col(key).alias("key"), F.col(body).alias("body")).mapInArrow(run, f"key {kind}, layout string, fingerprint string, turns array<struct<role:string,text:string>>").withColumnRenamed("key", key)


def escape(text: str) -> str:
    """Backslashes are doubled and control strings broken, so that no text can close or open a turn."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Templated text and the spans (code points) of the assistant's texts: the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role).replace('\n', '\\n')}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    return [(unescape(role), unescape(body)) for role, body in (x.split("\n", 1) for x in (y[len(START) :] for y in text.split(f"{END}\n")[:-1]))]


def formatted(turns: DataFrame, key: str) -> DataFrame:
    """(key, formatted, loss_spans array<struct<start, end>>) of canonical() rows; no turns give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [render([(t["role"] or "", t["text"] or "") for t in x or []]) for x in b.column(1).to_pylist()]
            spans = [[{"start": s, "end": e} for s, e in x] for _, x in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["key", "formatted", "loss_spans"])

    kind = turns.schema[key].dataType.simpleString()
    return turns.select(F.col(key).alias("key"), "turns").mapInArrow(run, f"key {kind}, formatted string, loss_spans array<struct<start:bigint,end:bigint>>").withColumnRenamed("key", key)


def read_back(done: DataFrame, key: str) -> DataFrame:
    """Digests of formatted() rows, from the formatted text and its mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))], names=["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = done.schema[key].dataType.simpleString()
    return done.select(F.col(key).alias("key"), "formatted", "loss_spans").mapInArrow(run, f"key {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").withColumnRenamed("key", key)


def records_of(rows: DataFrame) -> DataFrame:
    """Rows of turns (conv_id, turn, role, text) as one record of layout messages for each conv_id: (conv_id, body).

    Turns are in order of turn, null first; ties by role, then text. Null roles and texts are empty; null conv_ids form
    one conversation. A conversation becomes one row in any case, so its turns are gathered in one.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("x"))
    return listed.select("conv_id", F.to_json(F.struct(F.transform("x", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))).alias("body"))
