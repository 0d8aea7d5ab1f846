"""Chat formatting by schema fingerprinting.

Records of any layout (JSON objects) are told apart by the fingerprint of their schema: a hash of
their sorted field paths, where list items are `[]`, each with the type of its value; values don't
count. Each known fingerprint selects a declarative mapping, which says where conversation, turn, role and text stand; one record
may hold one turn, or a prompt with its answer, or a list of messages. The result is canonical turns.

The template writes a user's turn as `[INST]text[/INST]`, an assistant's as `<s>text</s>` and that of
any other role as `<<SYS>>role`, a line feed, the text and `<</SYS>>`. Control strings inside roles
and texts get a backslash behind their first character, and backslashes are doubled, so that no
control string but the template's own remains and nothing is lost. The loss mask covers the text of
assistant turns. Turns are formatted row by row; only the digests of whole conversations need their
turns in order, in a pass over sorted partitions that holds one turn at a time.

Defined results: null texts and roles are empty; turns with equal conversation and number are put in
order by role, then text, and all stay; a null conversation is one of its own; a null turn number comes
first. A record whose fingerprint is unknown gives one row in `unmapped`, no turn; the digests have
a row for each such fingerprint, with the number of its records and nothing else. A field of another type
than the layout's (a number as text, a text as turn number, an integer beyond 64 bits) makes a fingerprint
unknown; a line that is no JSON, or holds half a surrogate pair, has the fingerprint `MALFORMED`. Conversation
ids are integers or, with ids="string", integers and texts, all kept as text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations, product

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import settle

CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(\\?)")


MALFORMED = "malformed"
# Types of a field's values: s text, i integer of 64 bits, f other number, b boolean, n null, e empty.
TEXT, NUMBER, ANY_ID = "sn", "in", "isn"


def _type(value) -> str:
    if value is None:
        return "n"
    if isinstance(value, str):
        return "s"
    if isinstance(value, bool):
        return "b"
    return "i" if isinstance(value, int) and -1 << 63 <= value < 1 << 63 else "f"


def paths(value, prefix: str = "") -> set[str]:
    """The field paths of a JSON value, with the types of their values."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else {f"{prefix}:e"}
    if isinstance(value, list):
        return set().union(*(paths(v, prefix + "[]") for v in value)) if value else {prefix + "[]:e"}
    return {f"{prefix}:{_type(value)}"}


def parsed(line: str | None) -> tuple[object, str]:
    """A record and its fingerprint; a null line is an empty record."""
    try:
        record = json.loads(line) if line is not None else {}
        if line and "\\u" in line:
            json.dumps(record, ensure_ascii=False).encode()
        return record, fingerprint(paths(record))
    except (ValueError, RecursionError):
        return None, MALFORMED


def fingerprint(fields: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps what a turn needs.

    `fields` are the paths it always has, `optional` those it may have. `conversation` and `turn`
    name its fields of that meaning. Either `messages` names a list whose items hold `role` and
    `text`; or `role` and `text` name fields of a record that is one turn; or `speakers` lists
    (role, fields): the texts of those fields, joined by line feeds, are that role's turn.
    """

    name: str
    fields: tuple[str, ...]
    optional: tuple[str, ...] = ()
    conversation: str = "id"
    turn: str | None = None
    messages: str | None = None
    role: str | None = None
    text: str | None = None
    speakers: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def fingerprints(self, id_types: str = NUMBER) -> Iterator[str]:
        """Those of all choices of optional fields and of the types that its values may have."""
        choices = []
        for field in (*self.fields, *self.optional):
            types = id_types if field == self.conversation else NUMBER if field == self.turn else TEXT
            # The items of a list may have several.
            most = len(types) if "[]" in field else 1
            found = [[f"{field}:{t}" for t in chosen] for n in range(1, most + 1) for chosen in combinations(types, n)]
            choices.append(found + [[]] * (field in self.optional))
        for picked in product(*choices):
            yield fingerprint({path for part in picked for path in part})

    def turns(self, record: dict) -> Iterator[tuple[int | None, str, str]]:
        """Number, role and text of each turn of a record."""
        first = record.get(self.turn) if self.turn else 0
        if self.messages:
            for k, item in enumerate(record[self.messages]):
                yield first + k, item.get(self.role), item.get(self.text)
        elif self.speakers:
            for k, (role, fields) in enumerate(self.speakers):
                given = [record[f] for f in fields if record.get(f)]
                if given or role != "system":
                    yield first + k, role, "\n".join(given)
        else:
            yield first, record.get(self.role), record.get(self.text)


LAYOUTS = (
    Layout("turn rows", ("conv_id", "turn", "role", "text"), conversation="conv_id", turn="turn", role="role", text="text"),
    Layout("messages", ("messages[].role", "messages[].content"), ("id",), messages="messages", role="role", text="content"),
    Layout("shared", ("conversations[].from", "conversations[].value"), ("id",), messages="conversations", role="from", text="value"),
    Layout("prompt", ("prompt", "response"), ("id", "system"),
           speakers=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), ("id", "input", "system"),
           speakers=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
)
# Names that layouts use for the roles the template knows.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant"}


WHOLE = 32  # turns of the longest conversation that is written as one record


def records_of(turns: list[tuple]) -> list[dict]:
    """One conversation's turns (conv_id, turn, role, text), in order, in the layout of its own shape.

    A prompt with its answer, after a system's text or not, is one record: `instruction` where the
    prompt has lines below its first, else `prompt`. Other conversations are `shared` if only users
    and assistants speak, else `messages`. Those layouts number turns from zero; conversations that
    are numbered otherwise, that use a name of `ROLES`, or are long, are turn rows.
    """
    roles = [t[2] for t in turns]
    if len(turns) > WHOLE or [t[1] for t in turns] != list(range(len(turns))) or any(r in ROLES for r in roles):
        return [dict(zip(("conv_id", "turn", "role", "text"), t, strict=True)) for t in turns]
    own, texts = {"id": turns[0][0]}, [t[3] for t in turns]
    if roles == ["user", "assistant"] or roles == ["system", "user", "assistant"] and texts[0]:
        *system, asked, answer = texts
        own |= {"system": s for s in system}
        first, _, rest = (asked or "").partition("\n")
        if first and rest:
            return [{**own, "instruction": first, "input": rest, "output": answer}]
        return [{**own, "prompt": asked, "response": answer}]
    if {*roles} <= {"user", "assistant"}:
        names = {"user": "human", "assistant": "gpt"}
        return [{**own, "conversations": [{"from": names[r], "value": t} for r, t in zip(roles, texts, strict=True)]}]
    return [{**own, "messages": [{"role": r, "content": t} for r, t in zip(roles, texts, strict=True)]}]


def write_records(rows: DataFrame) -> DataFrame:
    """Turn rows (conv_id, turn, role, text) as JSON records of several layouts: column record.

    Holds at most `WHOLE` turns of a conversation at a time. The records of a conversation follow each
    other, in the order of its turns, in one partition.
    """
    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, long = object(), [], False
        for batch in batches:
            done = []
            ids = ([None if v is None else int(v) for v in batch[c]] for c in ("conv_id", "turn"))
            for turn in zip(*ids, batch["role"], batch["text"], strict=True):
                if turn[0] != now:
                    done += records_of(held) if held else []
                    now, held, long = turn[0], [], False
                held.append(turn)
                if long or len(held) > WHOLE:
                    done += [dict(zip(("conv_id", "turn", "role", "text"), t, strict=True)) for t in held]
                    held, long = [], True
            yield pd.DataFrame({"record": [json.dumps(r, ensure_ascii=False) for r in done]}, dtype=object)
        if held:
            yield pd.DataFrame({"record": [json.dumps(r, ensure_ascii=False) for r in records_of(held)]}, dtype=object)

    shown = [F.coalesce(c, F.lit("")) for c in ("role", "text")]
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", *shown)
    # Numbers go as text: a batch with nulls would round large ones.
    numbers = [F.col(c).cast("string").alias(c) for c in ("conv_id", "turn")]
    return ordered.select(*numbers, "role", "text").mapInPandas(written, "record string")


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, roles: Mapping[str, str] = ROLES,
                    column: str = "record", ids: str = "long") -> DataFrame:
    """conv_id, turn, role, text, layout of each turn, and unmapped: the fingerprint of a record no
    mapping is known for (its other columns are then null). `records` has JSON objects in one column;
    `ids` is the type of conv_id, long or string."""
    id_types = ANY_ID if ids == "string" else NUMBER
    by_print = {p: layout for layout in layouts for p in layout.fingerprints(id_types)}

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for shown in batch[column]:
                record, own = parsed(shown)
                layout = by_print.get(own)
                if layout is None:
                    found.append((None, None, None, None, None, own))
                    continue
                conversation = record.get(layout.conversation)
                if ids == "string" and conversation is not None:
                    conversation = str(conversation)
                for turn, role, text in layout.turns(record):
                    role = roles.get(role, role) or "" if layout.messages else role or ""
                    found.append((conversation, turn, role, text or "", layout.name, None))
            out = pd.DataFrame(found, columns=["conv_id", "turn", "role", "text", "layout", "unmapped"])
            yield out.astype({"turn": "Int64"} | ({"conv_id": "Int64"} if ids == "long" else {}))

    return records.select(F.col(column).cast("string").alias(column)).mapInPandas(
        mapped, f"conv_id {ids}, turn long, role string, text string, layout string, unmapped string")


def escape(text: str) -> str:
    doubled = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], doubled)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group(1), text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the part of it that counts for the loss."""
    inside = escape(text)
    if role == "user":
        return f"[INST]{inside}[/INST]", 0, 0
    if role == "assistant":
        return f"<s>{inside}</s>", 3, 3 + len(inside)
    return f"<<SYS>>{escape(role).replace('\n', '\\n')}\n{inside}<</SYS>>", 0, 0


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if formatted.startswith("[INST]"):
        return "user", unescape(formatted[6:-7])
    if formatted.startswith("<s>"):
        return "assistant", unescape(formatted[3:-4])
    role, _, text = formatted[7:-8].partition("\n")
    return _role(role), unescape(text)


def _role(escaped: str) -> str:
    """Undoes the escapes of a role, where a line feed is written as backslash and n."""
    return re.sub(r"\\([\\n]?)", lambda m: "\n" if m.group(1) == "n" else m.group(1), escaped)


def format_turns(turns: DataFrame) -> DataFrame:
    """Each turn with its formatted text and its loss mask (code points from mask_start to mask_end).

    A conversation's text is that of its turns in order, with nothing between them. Rows of unmapped
    records, if there are any, stay as they are.
    """
    kept = [c for c in ("conv_id", "turn", "role", "text", "unmapped") if c in turns.columns]

    def formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(None, None, None) if text is None else format_turn(role, text) for role, text in zip(batch["role"], batch["text"], strict=True)]
            out = batch[kept].copy()
            out["formatted"], out["mask_start"], out["mask_end"] = (
                [f[k] for f in found] for k in range(3)) if found else ([], [], [])
            yield out.astype({"mask_start": "Int32", "mask_end": "Int32"})

    types = ", ".join(f"`{c}` {turns.schema[c].dataType.simpleString()}" for c in kept)
    return turns.select(*kept).mapInPandas(formatted, f"{types}, formatted string, mask_start int, mask_end int")


# Fingerprints of unmapped records that a task counts at a time.
COUNTED = 10_000


def digests(formatted: DataFrame, grouped: bool = False) -> DataFrame:
    """What is read back from the formatted turns of each conversation, and the number of records of
    each unmapped fingerprint, counted by every task for itself.

    `grouped`: the turns of a conversation already follow each other, in order, in one partition.
    """
    ids = formatted.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {ids}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
              "unmapped string, n_records long")
    if "unmapped" not in formatted.columns:
        formatted = formatted.withColumn("unmapped", F.lit(None).cast("string"))

    def table(rows: list[tuple], lost: Counter) -> pd.DataFrame:
        rows = [(*row, None, None) for row in rows] + [(None,) * 6 + item for item in lost.items()]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
        return out.astype({c: "Int64" for c in ("n_turns", "loss_chars", "formatted_chars", "n_records", *["conv_id"] * (ids == "bigint"))})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, done, lost = object(), None, [], Counter()

        def row():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            numbers = batch["conv_id"] if ids == "string" else batch["conv_id"].astype("Int64")
            for conv_id, piece, start, end, unmapped in zip(
                    numbers, batch["formatted"], batch["mask_start"], batch["mask_end"], batch["unmapped"], strict=True):
                if unmapped is not None:
                    lost[unmapped] += 1
                    continue
                conv_id = None if conv_id is None or conv_id is pd.NA else conv_id if ids == "string" else int(conv_id)
                if state is None or conv_id != now:
                    if state is not None:
                        done.append(row())
                    now, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(piece)
                masked = unescape(piece[int(start):int(end)])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(piece)
            if len(lost) > COUNTED:
                yield table(done, lost)
                done, lost = [], Counter()
            elif done:
                yield table(done, Counter())
                done = []
        yield table(done + ([row()] if state is not None else []), lost)

    if not grouped:
        # Unmapped records have no conversation; they stay spread as they are.
        spread = F.when(F.col("unmapped").isNotNull(), F.spark_partition_id())
        formatted = formatted.repartition("conv_id", spread).sortWithinPartitions("conv_id", "turn", "role", "text")
    return formatted.select("conv_id", "formatted", "mask_start", "mask_end", "unmapped").mapInPandas(read, schema)


def format_conversations(records: DataFrame, grouped: bool = False, ids: str = "long") -> DataFrame:
    """From records of any known layout to the digests of their formatted conversations.

    Records that no mapping is known for are rows of their own: `unmapped` is their fingerprint and
    `n_records` their number, all else is null. `grouped`: as `write_records` leaves them.
    """
    found = settle(digests(format_turns(canonical_turns(records, ids=ids)), grouped), "chat-digests")
    lost = found.where("unmapped IS NOT NULL").groupBy("unmapped").agg(F.sum("n_records").alias("n_records"))
    return found.where("unmapped IS NULL").drop("unmapped", "n_records").unionByName(lost, allowMissingColumns=True)
