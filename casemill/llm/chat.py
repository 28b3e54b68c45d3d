"""Chat formatting: records of many layouts become canonical turns, and turns one training text.

The layout of a JSON record is known by a fingerprint, the hash of its nested field paths. A fingerprint selects a
declared mapping to turns of role and text; records with other fields get none. The template marks turns with control
strings. Texts are escaped so that no control string can appear in them, and the escape can be undone.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from casemill.llm.common import let, quoted, without

TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """A mapping: either ``fields`` as ``(role, field)`` in the order of the turns, or a list of objects at ``turns``
    with the fields ``role`` and ``text``; ``roles`` translates other names of roles."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def examples(self) -> list[str]:
        """Records with the field paths of the layout."""
        if self.fields:
            return [json.dumps({name: "" for _, name in self.fields})]
        return [json.dumps({self.turns: some}) for some in ([{self.role: "", self.text: ""}], [])]

    def mapped(self, record: Column) -> Column:
        if self.fields:
            schema = ", ".join(f"`{name}` string" for _, name in self.fields)
            return let(
                F.from_json(record, schema),
                lambda r: F.array(*[_turn(F.lit(role), r[name]) for role, name in self.fields]),
            )
        schema = f"`{self.turns}` array<struct<`{self.role}`: string, `{self.text}`: string>>"

        def one(turn: Column) -> Column:
            role = turn[self.role]
            for other, name in self.roles.items():
                role = F.when(turn[self.role] == other, name).otherwise(role)
            return _turn(role, turn[self.text])

        return F.transform(F.from_json(record, schema)[self.turns], one)


LAYOUTS = (
    Layout("messages", turns="messages", role="role", text="content"),
    Layout("conversations", turns="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt_completion", (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", (("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt_response", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction_output", (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input_output", (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def field_paths(record: Column) -> Column:
    """The nested fields of a JSON record by name, without the types of their values; null if it is no JSON."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(schema, r"\b(?:STRING|VOID|VARIANT|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|BINARY|DECIMAL\(\d+,\d+\))(?=[,>]|$)", "_")


def fingerprint(record: Column) -> Column:
    return F.sha2(field_paths(record).cast("binary"), 256)


def canonical(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with ``layout`` and ``turns`` in place of the record; both are null for unknown layouts and null records.

    Null fields are empty texts.
    """
    spark = df.sparkSession
    examples = [(x.name, e) for x in layouts for e in x.examples()]
    known = {}  # a row for each declared layout
    for name, print_ in spark.createDataFrame(examples, "name string, record string").select("name", fingerprint(F.col("record"))).collect():
        known.setdefault(name, []).append(print_)
    plain = without(df, ["layout", "turns"]).withColumn("_print", fingerprint(quoted(record)))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        matches = F.col("_print").isin(known[layout.name])
        name = F.when(matches, layout.name).otherwise(name)
        turns = F.when(matches, layout.mapped(quoted(record))).otherwise(turns)
    return plain.select(*[quoted(c) for c in plain.columns if c not in ("_print", record)], name.alias("layout"), turns.alias("turns"))


#: The template: a turn is START, role, newline, text, END.
START, END = "<|im_start|>", "<|im_end|>\n"
#: Every control string begins with one of these characters; they and the escape character are escaped.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("\n", "\\3"))


def escaped(text: Column, role: bool = False) -> Column:
    """The text without characters that begin control strings; in a role also without newlines."""
    for plain, code in ESCAPES[: 4 if role else 3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Undo ``escaped``. Each escape character begins a code, so that codes other than its own can go first."""
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def rendered(turns: Column, learned: str = "assistant") -> Column:
    """``text`` and ``loss``, the spans ``start, end`` (code points) of the texts of the learned role."""
    part = lambda t: F.struct(
        F.concat(F.lit(START), escaped(t["role"], True), F.lit("\n")).alias("head"),
        escaped(t["text"]).alias("body"),
        (t["role"] == learned).alias("learned"),
    )

    def joined(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END))
        starts = F.aggregate(
            lengths,
            F.array(F.lit(0)),
            lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)),
        )
        spans = lambda at: F.filter(
            F.transform(
                parts,
                lambda p, i: F.struct(
                    (F.get(at, i) + F.length(p["head"])).alias("start"),
                    (F.get(at, i) + F.length(p["head"]) + F.length(p["body"])).alias("end"),
                    p["learned"].alias("learned"),
                ),
            ),
            lambda s: s["learned"],
        )
        return F.struct(
            F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("text"),
            F.transform(let(starts, spans), lambda s: F.struct(s["start"], s["end"])).alias("loss"),
        )

    return let(F.transform(turns, part), joined)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: F.length(p) > 0)

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(len(START) + 1), F.length(part))
        head = F.substring_index(body, "\n", 1)
        return F.struct(
            unescaped(head).alias("role"), unescaped(F.substring(body, F.length(head) + 2, F.length(body))).alias("text")
        )

    return F.transform(parts, turn)


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )


def format_chats(df: DataFrame, record: str = "record") -> DataFrame:
    """``df`` with ``layout``, ``formatted`` and ``loss`` in place of the record; null for unknown layouts.

    A record without turns gives an empty text.
    """
    made = without(canonical(df, record), ["formatted", "loss"]).withColumn("_made", rendered(F.col("turns")))
    return made.select(
        *[quoted(c) for c in made.columns if c not in ("turns", "_made")],
        F.col("_made.text").alias("formatted"),
        F.col("_made.loss").alias("loss"),
    )


def records_of_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, record``: rows of turns gathered into JSON records, in the most compact layout that holds them.

    Turns with the same number are in the order of role and text. Null roles and texts are empty. A conversation is
    gathered in one task, as a document is.
    """
    turns = F.sort_array(
        F.collect_list(
            F.struct(
                quoted(turn).alias("turn"),
                F.coalesce(quoted(role).cast("string"), F.lit("")).alias("role"),
                F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"),
            )
        )
    )
    gathered = rows.groupBy(quoted(conv_id).alias("conv_id")).agg(turns.alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    said = lambda i, name: F.get(F.col("turns"), F.lit(i))["text"].alias(name)
    dialogue = F.forall(roles, lambda r: r.isin("user", "assistant"))
    spoken = F.transform(
        "turns", lambda t: F.struct(F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), t["text"].alias("value"))
    )
    listed = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    record = (
        F.when(is_("user", "assistant"), F.to_json(F.struct(said(0, "prompt"), said(1, "completion"))))
        .when(is_("system", "user", "assistant"), F.to_json(F.struct(said(0, "instruction"), said(1, "input"), said(2, "output"))))
        .when(dialogue, F.to_json(F.struct(spoken.alias("conversations"))))
        .otherwise(F.to_json(F.struct(listed.alias("messages"))))
    )
    return gathered.select("conv_id", record.alias("record"))
