"""Chat formatting: schema fingerprints choose declarative mappings into canonical turns.

A record's layout is the sorted set of its nested field paths; its hash selects
a mapping, which only names where roles and texts are. Canonical turns are
rendered with a template whose control strings are escaped inside texts, so
that the output can be read back without loss.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import project


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    `turns`: the path of the list of messages ('' if the fields are the record's
    own). `fields`: (role, text path) pairs; a role written '@path' is read from
    the message. `join`: fields whose non-empty texts go into one turn with the
    one before. `renamed`: whether the layout has names of its own for roles.
    """

    name: str
    paths: tuple[str, ...]
    turns: str
    fields: tuple[tuple[str, str], ...]
    join: tuple[str, ...] = ()
    renamed: bool = False


#: Fixed names that layouts use for roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
MAPPINGS = (
    Mapping("turn_rows", ("conv_id", "role", "text", "turn"), "", (("@role", "text"),)),
    Mapping("messages", ("messages[].content", "messages[].role"), "messages", (("@role", "content"),)),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), "conversations", (("@from", "value"),), renamed=True),
    Mapping("message", ("content", "role"), "", (("@role", "content"),)),
    Mapping("from_value_turn", ("from", "value"), "", (("@from", "value"),), renamed=True),
    Mapping("instruction", ("input", "instruction", "output"), "", (("user", "instruction"), ("user", "input"), ("assistant", "output")), ("input",)),
    Mapping("instruction_only", ("instruction", "output"), "", (("user", "instruction"), ("assistant", "output"))),
    Mapping("prompt_completion", ("completion", "prompt"), "", (("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response", "system"), "", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", ("answer", "question"), "", (("user", "question"), ("assistant", "answer"))),
)


def fingerprint(paths: list[str] | tuple[str, ...]) -> str:
    """The hash of a layout: SHA-256 of its sorted distinct paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def record_paths(value: object, at: str = "") -> list[str]:
    """Nested field paths of a JSON value; items of a list share `[]`."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in record_paths(v, f"{at}.{k}" if at else k)]
    if isinstance(value, list):
        return [p for v in value for p in record_paths(v, f"{at}[]")] or [at]
    return [at]


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a Spark schema, written as `record_paths` writes them."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


#: Every set of paths that some mapping knows, widest first: what a layout is cut to before it is looked up.
_KNOWN = sorted({frozenset(m.paths) for m in MAPPINGS}, key=lambda x: (-len(x), sorted(x)))


@functools.lru_cache(maxsize=10_000)
def _selected(paths: frozenset[str]) -> Mapping | None:
    cuts = [paths, *(paths & known for known in _KNOWN)]
    return next((m for c in cuts if (m := BY_FINGERPRINT.get(fingerprint(tuple(c))))), None)


def select_mapping(paths: list[str]) -> Mapping | None:
    """The mapping whose fingerprint these paths have; else, extra fields left out, the one with most paths; else none."""
    return _selected(frozenset(paths))


def _get(record: object, path: str) -> object:
    for step in path.split("."):
        record = record.get(step) if isinstance(record, dict) else None
    return record


def canonical_turns(record: dict) -> tuple[str | None, list[tuple[str, str]]]:
    """(mapping name, turns) of one record; an unknown layout gives (None, []); null texts are empty."""
    mapping = select_mapping(record_paths(record))
    if mapping is None:
        return None, []
    turns: list[tuple[str, str]] = []
    for message in _get(record, mapping.turns) or [] if mapping.turns else [record]:
        for role, path in mapping.fields:
            value = _get(message, path)
            text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
            role = str(_get(message, role[1:]) or "") if role[0] == "@" else role
            role = ROLE_NAMES.get(role, role) if mapping.renamed else role
            if path in mapping.join:
                if text:
                    turns[-1] = (turns[-1][0], f"{turns[-1][1]}\n{text}")
            elif text or role != "system" or mapping.turns:
                turns.append((role, text))
    return mapping.name, turns


OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Fixed control strings of common templates; none may occur in a rendered text.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
_CONTROL = re.compile("|".join(sorted(map(re.escape, CONTROLS), key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.DOTALL)


def escape(text: str) -> str:
    r"""Backslashes are doubled, and `\:` goes behind the first character of every control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\:" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {":": "", "n": "\n"}.get(m[1], m[1]), text)


def render(role: str, text: str) -> str:
    """One turn in the template; a line break in a role is written `\\n`."""
    return OPEN + escape(role).replace("\n", "\\n") + "\n" + escape(text) + CLOSE


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns of a rendered text: (role, text, start and end of the escaped text)."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


def format_records(records: DataFrame, column: str = "record") -> DataFrame:
    """JSON records of mixed layouts, one conversation each: (record, layout, formatted, loss array<struct<start,end>>).

    Null, malformed and unknown records have layout null, no text and no loss.
    Loss spans are the assistant's escaped texts, in code points of `formatted`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, texts, masks = [], [], []
            for raw in b.column(0).to_pylist():
                try:
                    record = json.loads(raw or "")
                except ValueError:
                    record = None
                name, turns = canonical_turns(record) if isinstance(record, dict) else (None, [])
                text = "".join(render(r, t) for r, t in turns)
                names.append(name)
                texts.append(text if name else None)
                masks.append([{"start": a, "end": e} for r, _, a, e in read_back(text) if r == "assistant"])
            loss = pa.array(masks, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(texts, pa.string()), loss], ["record", "layout", "formatted", "loss"])

    return project(records, **{column: "string"}).mapInArrow(run, "record string, layout string, formatted string, loss array<struct<start:int,end:int>>")


def canonical_rows(records: DataFrame) -> DataFrame:
    """Turns of JSON records (conv_id, turn, record) of any known layout: (conv_id, turn, part, role, text), a record's turns as parts 0, 1, ..

    Each record's layout is told by its own fingerprint. Null, malformed and
    unknown records have no turns. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for conv, turn, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                try:
                    record = json.loads(raw.as_py() or "")
                except ValueError:
                    continue
                if isinstance(record, dict):
                    out += [(conv, turn, k, role, text) for k, (role, text) in enumerate(canonical_turns(record)[1])]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "turn", "part", "role", "text"])

    d = project(records, conv_id="long", turn="long", record="string")
    return d.mapInArrow(run, "conv_id long, turn long, part int, role string, text string")


def as_records(rows: DataFrame) -> DataFrame:
    """Turn rows as JSON records (conv_id, turn, record) in three layouts by conversation; only users and assistants have a second name."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    options = {"ignoreNullFields": "false"}
    layouts = (
        F.to_json(F.struct(role.alias("role"), text.alias("content")), options),
        F.to_json(F.struct(F.when(role == "user", "human").otherwise("gpt").alias("from"), text.alias("value")), options),
        F.to_json(F.struct("conv_id", "turn", role.alias("role"), text.alias("text")), options),
    )
    kind = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3))
    record = F.when((kind == 1) & role.isin("user", "assistant"), layouts[1]).when(kind == 2, layouts[2]).otherwise(layouts[0])
    return rows.select("conv_id", "turn", record.alias("record"))


def format_turns(rows: DataFrame) -> DataFrame:
    """Conversations kept as turn rows, formatted: (conv_id, turn, role, formatted, loss boolean), one row a turn.

    Roles keep their names. A conversation's text is its rows' `formatted` joined in order of (turn,
    role, text), nulls first. Null texts and roles are empty. Rows that repeat
    stay turns of their own; a null conv_id is one conversation. The layout is
    chosen by the schema's fingerprint; other columns are ignored.
    """
    mapping = select_mapping(schema_paths(rows.schema))
    if mapping is None or mapping.name != "turn_rows":
        raise ValueError("no turn-row mapping fits this schema")
    (role, text) = mapping.fields[0]
    d = project(rows, conv_id="long", turn="long", **{role[1:]: "string", text: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles = [r or "" for r in b.column(2).to_pylist()]
            out = [render(r, t or "") for r, t in zip(roles, b.column(3).to_pylist(), strict=True)]
            loss = pa.array([r == "assistant" for r in roles], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(roles, pa.string()), pa.array(out, pa.string()), loss], ["conv_id", "turn", "role", "formatted", "loss"])

    ordered = d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, turn long, role string, formatted string, loss boolean")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Digests of `format_turns`, read back from its output: one row a conversation.

    Turns of a conversation arrive in order in one partition and are digested
    as they stream by, so a conversation of any length takes constant memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now = [], None

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            rows.clear()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def close() -> None:
            if now:
                rows.append((now["id"], now["n"], now["turns"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"]))

        for b in batches:
            for conv, formatted, loss in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if now is None or now["id"] != conv:
                    close()
                    now = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                for role, text, _, _ in read_back(formatted):
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if loss:
                        now["loss_chars"] += len(text)
                        now["loss"].update(text.encode("utf-8", "surrogatepass"))
                now["chars"] += len(formatted)
            if len(rows) > 10_000:
                yield batch()
        close()
        yield batch()

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def with_planted(rows: DataFrame) -> DataFrame:
    """The rows and conversation -7, whose texts are control strings."""
    d = project(rows, conv_id="long", turn="long", role="string", text="string")
    return d.union(d.sparkSession.createDataFrame(PLANTED, d.schema))


def oracle() -> str:
    """The digests in DuckDB SQL, with the template's length worked out from its parts."""
    escaped = "replace(t, '\\', '\\\\')"
    for c in CONTROLS:
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\:{c[1:]}')"
    planted = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in PLANTED)
    fixed = len(OPEN) + 1 + len(CLOSE)
    return f"""
      WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
        UNION ALL SELECT * FROM (VALUES {planted}) v(conv_id, turn, r, t))
      SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
        coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
        sum(length(r) + length({escaped}) + {fixed})::BIGINT AS formatted_chars
      FROM rows GROUP BY conv_id"""
