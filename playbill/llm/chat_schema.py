"""Chat formatting: schema fingerprints select declarative mappings into canonical turns, turns become one marked text.

A fingerprint hashes the nested field paths of a record that any mapping knows, sorted: of a table by its schema, of a JSON
record by the paths that are present in it. Each mapping says where a layout keeps its turns. The canonical form is one row
for each turn: conv_id, position, role, text. The template marks turns, and puts a backslash into every control string (and
before every backslash) inside roles and texts, which ``read_back`` undoes. A loss mask lists the spans of assistant texts.

Null texts and roles are empty; turns of a conversation are ordered by turn (null first), then role and text, so that ties and
repeated rows have one order; rows of a null conv_id are one conversation; a record of unknown fingerprint gives no turns and
is listed by ``unmapped``; empty tables give no rows. A conversation is one training record and is held whole in a row.
Everything is built-in expressions."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common templates: a backslash goes between the two groups.
CONTROL = r"(<|\[)(\||/?s>|</?SYS>>|/?INST\])"
LEARNED = "assistant"
#: Names that layouts give to the canonical roles.
ROLES = {"human": "user", "prompter": "user", "question": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "answer": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """``turns`` lists (role or the path of a role, path of a text); a path with ``[]`` stands for a list of turns."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]


MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), (("messages[].role", "messages[].content"),)),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), (("conversations[].from", "conversations[].value"),)),
    Mapping("instruction", ("instruction", "output"), (("=user", "instruction"), ("=assistant", "output"))),
    Mapping("instruction_input", ("instruction", "input", "output"), (("=user", "instruction"), ("=user", "input"), ("=assistant", "output"))),
    Mapping("system_instruction", ("system", "instruction", "output"), (("=system", "system"), ("=user", "instruction"), ("=assistant", "output"))),
    Mapping("prompt_completion", ("prompt", "completion"), (("=user", "prompt"), ("=assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), (("=user", "prompt"), ("=assistant", "response"))),
    Mapping("question_answer", ("question", "answer"), (("=user", "question"), ("=assistant", "answer"))),
    Mapping("turn_rows", ("conv_id", "turn", "role", "text"), ()),
)
JSON_FIELDS = (
    "messages array<struct<role: string, content: string>>, conversations array<struct<`from`: string, value: string>>, instruction string, "
    "input string, output string, system string, prompt string, completion string, response string, question string, answer string")
KNOWN = frozenset(p for m in MAPPINGS for p in m.paths)


def fingerprint(paths) -> str:
    return hashlib.sha256(",".join(sorted(set(paths) & KNOWN)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def field_paths(kind: DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema; list elements are written ``[]``."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return field_paths(kind.elementType, f"{at}[]") if isinstance(kind, ArrayType) else [at]


def record_fingerprint(record: Column) -> Column:
    """The fingerprint of one parsed JSON record: of the known paths that hold a value."""
    def present(path: str) -> Column:
        top, _, leaf = path.partition("[].")
        return F.exists(record[top], lambda e: e[leaf].isNotNull()) if leaf else record[top].isNotNull()

    paths = sorted(p for p in KNOWN if p.partition("[]")[0] in {f.split()[0] for f in JSON_FIELDS.split(", ") if " " in f} or "[]" in p)
    return F.sha2(F.array_join(F.array_compact(F.array(*(F.when(present(p), F.lit(p)) for p in paths))), ","), 256)


def _role(role: Column) -> Column:
    low = F.lower(F.coalesce(role, F.lit("")))
    out = low
    for name, canonical in ROLES.items():
        out = F.when(low == name, F.lit(canonical)).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _each(turns: Column, role: str, text: str) -> Column:
    return F.transform(turns, lambda e: _turn(_role(e[role]), e[text]))


def _mapped(record: Column, mapping: Mapping) -> Column:
    """Turns of a record by one mapping, as a list of (role, text)."""
    lists = []
    for role, text in mapping.turns:
        if "[]" in text:
            top, _, leaf = text.partition("[].")
            role_leaf = role.partition("[].")[2]
            lists.append(_each(record[top], role_leaf, leaf))
        else:
            lists.append(F.array(_turn(F.lit(role[1:]), record[text])))
    return F.concat(*lists)


def canonical_records(records: DataFrame, json: str = "record") -> DataFrame:
    """Turns of JSON records (conv_id and a JSON text of any mapped layout)."""
    rows = records.withColumn("_record", F.from_json(json, JSON_FIELDS)).withColumn("_print", record_fingerprint(F.col("_record")))
    turns = F.lit(None)
    for key, mapping in BY_FINGERPRINT.items():
        if mapping.turns:
            turns = F.when(F.col("_print") == key, _mapped(F.col("_record"), mapping)).otherwise(turns)
    return rows.select("conv_id", F.posexplode(turns).alias("position", "_turn")).select(
        "conv_id", F.col("position").cast("long").alias("position"), "_turn.role", "_turn.text")


def unmapped(records: DataFrame, json: str = "record") -> DataFrame:
    """Records whose fingerprint no mapping has."""
    prints = record_fingerprint(F.from_json(json, JSON_FIELDS))
    return records.where(~F.coalesce(prints, F.lit("")).isin([k for k, m in BY_FINGERPRINT.items() if m.turns]))


def canonical(table: DataFrame) -> DataFrame:
    """Turns of a table whose own schema has a mapped layout; extra columns do not change its fingerprint."""
    paths = field_paths(table.schema)
    mapping = BY_FINGERPRINT.get(fingerprint(paths))
    if mapping is None:
        raise ValueError(f"no mapping for the field paths {sorted(set(paths) & KNOWN)}")
    if mapping.name == "turn_rows":
        text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
        return table.select("conv_id", F.col("turn").cast("long").alias("position"), text("role"), text("text"))
    record = F.struct(*(F.col(c) for c in table.columns))
    return table.select("conv_id", F.posexplode(_mapped(record, mapping)).alias("position", "_turn")).select(
        "conv_id", F.col("position").cast("long").alias("position"), "_turn.role", "_turn.text")


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """One row for each conversation: ``formatted`` and ``loss``, the (start, length) of each assistant text in it, in code points."""
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    pieces = turns.select(
        "conv_id", "position", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"))
    ordered = Window.partitionBy("conv_id").orderBy(F.col("position").asc_nulls_first(), "role", "text")
    whole = F.length("head") + F.length("body") + len(END)
    placed = pieces.withColumns({
        "n": F.row_number().over(ordered),
        "start": F.sum(whole).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.length("body") - len(END),
    })
    turn = F.struct("n", F.concat("head", "body", F.lit(END)).alias("piece"), "start", F.length("body").alias("length"), (F.col("role") == LEARNED).alias("learned"))
    return placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns")).select(
        "conv_id", F.array_join(F.transform("_turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("_turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss"))


def read_back(conversations: DataFrame) -> DataFrame:
    """``turns`` (role, text) parsed from the formatted text, and ``loss_text``, what its mask covers; both unescaped."""
    def turn(part: Column) -> Column:
        role = F.regexp_extract(part, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)
        text = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    parts = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")
    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"])))
    return conversations.withColumns({"turns": F.transform(parts, turn), "loss_text": F.array_join(masked, "")})


#: The contract's extra conversation, in another layout than the table's.
PROBE = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def digest(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.range(1).select(F.lit(-1).cast(conversations.schema["conv_id"].dataType).alias("conv_id"), F.lit(PROBE).alias("record"))
    rows = read_back(formatted(canonical(conversations).unionByName(canonical_records(probe))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
