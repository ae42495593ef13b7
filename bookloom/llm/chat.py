"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

A record's nested field paths, restricted to the paths that some mapping knows, are sorted and hashed;
the hash selects the mapping (prompt, instruction and message layouts). Canonical turns are rendered
with a template that escapes its control strings inside texts reversibly and says which code points
carry loss.

Defined results: null texts and roles are empty; turns of equal number are ordered by role, then text; repeated rows
are a turn each; a text of any length is kept whole, and a conversation is one row; records of an unknown layout
keep a row without turns and with layout null (the columns layout and turns of records are the mapping's); an empty
table gives an empty result; fields that no mapping knows are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

TURNS = "array<struct<role:string,text:string>>"
BEGIN, TURN, TEXT, END, CLOSE = "<s>", "<|turn|>", "<|text|>", "<|end|>", "</s>"
#: Starts of control strings, and the escape character itself; an escape character goes after the first character.
_CONTROL = r"\\|<(?=\||s>|/s>)|\[(?=INST\]|/INST\])"


@dataclass(frozen=True)
class Layout:
    name: str
    paths: tuple[str, ...]
    schema: str
    #: SQL over the parsed record r.
    turns: str

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def fingerprint_of(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


_ROLE = "CASE lower({0}) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE {0} END"


def _pair(first: str, second: str) -> str:
    return f"array(named_struct('role','user','text',{first}), named_struct('role','assistant','text',{second}))"


LAYOUTS = (
    Layout("messages", ("messages", "messages[].role", "messages[].content"), "messages array<struct<role:string,content:string>>", f"transform(r.messages, m -> named_struct('role', {_ROLE.format('m.role')}, 'text', m.content))"),
    Layout("shared", ("conversations", "conversations[].from", "conversations[].value"), "conversations array<struct<`from`:string,value:string>>", f"transform(r.conversations, m -> named_struct('role', {_ROLE.format('m.`from`')}, 'text', m.value))"),
    Layout("prompt", ("prompt", "response"), "prompt string, response string", _pair("r.prompt", "r.response")),
    Layout("completion", ("prompt", "completion"), "prompt string, completion string", _pair("r.prompt", "r.completion")),
    Layout("instruction", ("instruction", "output"), "instruction string, output string", _pair("r.instruction", "r.output")),
    Layout("instruction_input", ("instruction", "input", "output"), "instruction string, input string, output string", _pair("CASE WHEN coalesce(r.input, '') = '' THEN r.instruction ELSE concat(coalesce(r.instruction, ''), '\\n', r.input) END", "r.output")),
)


@dataclass(frozen=True)
class RowLayout:
    """Of tables with a row per turn: the columns that are conversation, turn, role and text, and SQL of the role."""

    name: str
    paths: tuple[str, str, str, str]
    role: str = "{0}"

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


ROW_LAYOUTS = (
    RowLayout("turn_rows", ("conv_id", "turn", "role", "text")),
    RowLayout("message_rows", ("conversation_id", "message_index", "role", "content")),
    RowLayout("shared_rows", ("id", "turn", "from", "value"), _ROLE),
)


def schema_paths(kind, prefix: str = "") -> list[str]:
    """Nested field paths of a table's type; [] marks array elements."""
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    if not isinstance(kind, StructType):
        return []
    dot = f"{prefix}." if prefix else ""
    return [p for f in kind.fields for p in (f"{dot}{f.name}", *schema_paths(f.dataType, f"{dot}{f.name}"))]


def fingerprint(json: Column) -> Column:
    """Of a JSON record: the hash of its sorted known field paths."""
    lists = sorted({p.split("[]")[0] for x in LAYOUTS for p in x.paths if "[]" in p})
    known = F.array(*(F.lit(p) for p in sorted({p for x in LAYOUTS for p in x.paths})))
    keys = lambda part: F.coalesce(F.json_object_keys(part), F.array().cast("array<string>"))

    def below(name: str) -> Column:
        """Of every element, so that it doesn't matter which one is first or has all fields."""
        items = F.coalesce(F.from_json(F.get_json_object(json, f"$.{name}"), "array<string>"), F.array().cast("array<string>"))
        return F.transform(F.array_distinct(F.flatten(F.transform(items, keys))), lambda k: F.concat(F.lit(f"{name}[]."), k))

    paths = F.concat(keys(json), *map(below, lists))
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_intersect(paths, known)), "\n"), 256), 1, 16)


def canonical_records(records: DataFrame, json: str) -> DataFrame:
    """records with layout and turns (TURNS) of the JSON column."""
    out = records.withColumn("__bl_fp", fingerprint(F.col(json)))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for x in LAYOUTS:
        hit = F.col("__bl_fp") == x.fingerprint
        layout = F.when(hit, x.name).otherwise(layout)
        turns = F.when(hit, F.expr(x.turns.replace("r.", f"from_json(`{json}`, '{x.schema}').")).cast(TURNS)).otherwise(turns)
    return out.withColumns({"layout": layout, "turns": turns}).drop("__bl_fp")


def canonical_rows(rows: DataFrame) -> DataFrame:
    """conv_id, layout and turns of a table with a row per turn: the fingerprint of its field paths selects the mapping
    of its columns; paths that no row layout knows are ignored."""
    paths = set(schema_paths(rows.schema))
    found = [x for x in ROW_LAYOUTS if fingerprint_of(paths & set(x.paths)) == x.fingerprint]
    if not found:
        raise ValueError(f"no row layout has the fingerprint of {sorted(paths)}")
    x = max(found, key=lambda x: len(x.paths))
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    conv, turn, role, text = x.paths
    turns = F.array_sort(F.collect_list(F.struct(F.col(f"`{turn}`").alias("turn"), F.expr(x.role.format(f"coalesce(cast(`{role}` AS string), '')")).alias("role"), blank(text).alias("text"))))
    return rows.groupBy(F.col(f"`{conv}`").alias("conv_id")).agg(turns.alias("turns")).select(
        "conv_id",
        F.lit(x.name).alias("layout"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).cast(TURNS).alias("turns"),
    )


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def render(records: DataFrame, trained: str = "assistant") -> DataFrame:
    """records (with turns) with formatted and loss_spans: start and end, in code points, of each trained text."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(TURN), escape(blank(t["role"])), F.lit(TEXT)).alias("head"),
            escape(blank(t["text"])).alias("body"),
            (blank(t["role"]) == trained).alias("trained"),
        ),
    )
    spans = "array<struct<start:int,end:int>>"

    def step(a: Column, p: Column) -> Column:
        begin = a["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        own = F.when(p["trained"], F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast(spans))
        return F.struct((end + len(END)).alias("at"), F.concat(a["all"], own).alias("all"))

    start = F.struct(F.lit(len(BEGIN)).alias("at"), F.array().cast(spans).alias("all"))
    whole = F.array_join(F.transform("__bl_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return (
        records.withColumn("__bl_parts", parts)
        .withColumns({
            "formatted": F.concat(F.lit(BEGIN), whole, F.lit(CLOSE)),
            "loss_spans": F.aggregate("__bl_parts", start, step, lambda a: a["all"]),
        })
        .drop("__bl_parts")
    )


def parse(formatted: Column) -> Column:
    """TURNS read back from a rendered record."""
    chunks = F.split(formatted, r"<\|turn\|>", -1)
    rest = F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0)))
    return F.transform(
        rest,
        lambda c: F.struct(
            unescape(F.substring_index(c, TEXT, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(c, TEXT, -1), END, 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    cut = lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))
    return F.array_join(F.transform(spans, cut), "")


def format_digests(conversations: DataFrame) -> DataFrame:
    """The digest columns of the query, read back from the rendered records."""
    spark = conversations.sparkSession
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(
        F.lit(-7).cast(conversations.schema["conv_id"].dataType).alias("conv_id"),
        F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("json"),
    )
    records = canonical_rows(conversations).unionByName(canonical_records(probe, "json").drop("json"))
    out = render(records).select("conv_id", "formatted", "loss_spans").withColumns({
        "__bl_turns": parse(F.col("formatted")),
        "__bl_loss": loss_text(F.col("formatted"), F.col("loss_spans")),
    })
    lines = F.array_join(F.transform("__bl_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("__bl_turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("__bl_loss").cast("long").alias("loss_chars"),
        F.sha2("__bl_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
