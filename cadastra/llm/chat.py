"""Chat formatting of records in many layouts.

A record is a JSON object. The set of its nested field paths, hashed, is its
fingerprint; the fingerprint selects a declared mapping that turns the record
into turns (role, text). Turns are written with a template whose control strings
are escaped inside texts, so that the formatted text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, functions as F, types as T

from cadastra.llm.arrow import map_rows

Turn = tuple[str, str]


def field_paths(value, prefix: str = "") -> Iterator[str]:
    """Paths to all leaves: ``a.b`` for a field of a field, ``a[]`` for the items of a list."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from field_paths(inner, f"{prefix}.{key}" if prefix else key)
    elif isinstance(value, list):
        for inner in value:
            yield from field_paths(inner, prefix + "[]")
    else:
        yield prefix


def fingerprint(paths: Iterable[str]) -> str:
    """The same for records of one layout, whatever their values and the order of their fields."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How records with certain field paths become turns.

    ``single`` lists (role, paths): the texts at the paths, joined by a blank
    line, are one turn. ``items`` names a list of messages whose role and text
    are under ``role`` and ``text``. ``pairs`` names a list of (user, assistant)
    lists. Turns come in the order single system turns, pairs, items, other
    single turns. ``roles`` renames roles. ``optional`` paths may be absent.
    """

    name: str
    single: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    pairs: str = ""
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def fingerprints(self) -> Iterator[str]:
        """One for each choice of optional paths."""
        paths = {p for _, ps in self.single for p in ps}
        if self.items:
            paths |= {f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"}
        if self.pairs:
            paths.add(f"{self.pairs}[][]")
        for n in range(len(self.optional) + 1):
            for absent in combinations(self.optional, n):
                yield fingerprint(paths - set(absent))

    def turns(self, record: dict) -> list[Turn]:
        def written(wanted) -> list[Turn]:
            found = [(role, [_text(record[p]) for p in paths if p in record]) for role, paths in self.single if wanted(role)]
            return [(role, "\n\n".join(t for t in texts if t)) for role, texts in found if texts]

        turns = written(lambda role: role == "system")
        for ask, answer in ((p + ["", ""])[:2] for p in record.get(self.pairs) or [] if isinstance(p, list)):
            turns += [("user", _text(ask)), ("assistant", _text(answer))]
        for item in record.get(self.items) or []:
            role = _text(item.get(self.role))
            turns.append((self.roles.get(role, role), _text(item.get(self.text))))
        return turns + written(lambda role: role != "system")


def _text(value) -> str:
    """Null counts as an empty text."""
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


MAPPINGS = (
    Mapping("messages", items="messages", role="role", text="content"),
    Mapping("messages_with_system", (("system", ("system",)),), items="messages", role="role", text="content"),
    Mapping("from_value", items="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Mapping("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Mapping("prompt_completion", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Mapping("prompt_response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Mapping("question_answer", (("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
    Mapping("history", (("system", ("system",)), ("user", ("query",)), ("assistant", ("response",))), pairs="history", optional=("system",)),
)

#: Control strings of the template: what opens and what closes a turn of each role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
#: Any other role is named in its turn.
OTHER = ("[ROLE]", "[SAYS]", "[/ROLE]")
START = "<s>"

_CONTROL = "|".join(re.escape(c) for c in (*[c for pair in MARKS.values() for c in pair], *OTHER, START))
_ESCAPED = re.compile(rf"\\|{_CONTROL}")
_CONTROLS = re.compile(_CONTROL)
_UNESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """A backslash doubles; a control string gets one after its first character."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def format_turns(turns: Sequence[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans (code points) of its assistant texts: the loss mask."""
    parts, at, mask = [START], len(START), []
    for role, text in turns:
        opening, closing = MARKS.get(role) or (f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2])
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(opening), at + len(opening) + len(body)))
        parts += [opening, body, closing]
        at += len(opening) + len(body) + len(closing)
    return "".join(parts), mask


def parse_turns(formatted: str) -> list[Turn]:
    """Turns of a formatted conversation."""
    by_opening = {opening: role for role, (opening, _) in MARKS.items()}
    turns: list[Turn] = []
    role, start = "", 0
    for m in _CONTROLS.finditer(formatted):
        if m[0] in by_opening:
            role, start = by_opening[m[0]], m.end()
        elif m[0] == OTHER[0]:
            start = m.end()
        elif m[0] == OTHER[1]:
            role, start = unescape(formatted[start : m.start()]), m.end()
        elif m[0] != START:
            turns.append((role, unescape(formatted[start : m.start()])))
    return turns


def format_records(records: DataFrame, id_col: str = "conv_id", record_col: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """``id_col``, fingerprint, mapping, formatted and loss_spans of every JSON record.

    Null texts count as empty. A record that isn't a JSON object, or whose
    fingerprint no mapping declares, keeps its row with a null mapping, text and
    mask. Rows are kept as they are, repeated and null ids too; other columns
    are not read.
    """
    chosen = {mark: m for m in mappings for mark in m.fingerprints()}
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
    schema = T.StructType([
        records.schema[id_col], T.StructField("fingerprint", T.StringType()), T.StructField("mapping", T.StringType()),
        T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(span)),
    ])

    def one(text: str | None) -> tuple:
        try:
            record = json.loads(text or "null")
        except ValueError:
            record = None
        if not isinstance(record, dict):
            return None, None, None, None
        mark = fingerprint(field_paths(record))
        if mark not in chosen:
            return mark, None, None, None
        formatted, mask = format_turns(chosen[mark].turns(record))
        return mark, chosen[mark].name, formatted, [{"start": a, "stop": b} for a, b in mask]

    def make():
        def rows(chunk):
            made = [one(text) for text in chunk[record_col]]
            out = {name: [m[i] for m in made] for i, name in enumerate(schema.names[1:])}
            return out | {id_col: chunk[id_col]}

        return rows

    return map_rows(records, [id_col, record_col], make, schema)


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``id_col``, formatted, turns and loss_text (all text under the mask, unescaped), read from the formatted text alone."""
    turn = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType([
        formatted.schema[id_col], T.StructField("formatted", T.StringType()), T.StructField("turns", T.ArrayType(turn)), T.StructField("loss_text", T.StringType()),
    ])

    def make():
        def rows(chunk):
            texts, masks = chunk["formatted"], chunk["loss_spans"]
            return {
                id_col: chunk[id_col], "formatted": texts,
                "turns": [None if t is None else [{"role": r, "text": x} for r, x in parse_turns(t)] for t in texts],
                "loss_text": [None if t is None else "".join(unescape(t[s["start"] : s["stop"]]) for s in m) for t, m in zip(texts, masks)],
            }

        return rows

    return map_rows(formatted, [id_col, "formatted", "loss_spans"], make, schema)


def message_records(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One JSON record in the layout ``messages`` for each conversation of a table of turns.

    Turns are ordered by their number, null first, and rows of one number by
    role and text; null roles and texts count as empty. A conversation is one
    record, and so one row, however many turns it has.
    """
    message = F.struct(F.coalesce(rows[f"`{role_col}`"], F.lit("")).alias("role"), F.coalesce(rows[f"`{text_col}`"], F.lit("")).alias("content"))
    turns = rows.select(rows[f"`{id_col}`"].alias(id_col), F.struct(rows[f"`{turn_col}`"].alias("turn"), message.alias("m")).alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: t["m"])
    return turns.groupBy(id_col).agg(F.to_json(F.struct(ordered.alias("messages"))).alias("record"))
