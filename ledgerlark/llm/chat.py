"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns; a reversible template marks them.

A record's fingerprint is a hash of its nested field paths, whatever the values and their types. Each known layout is one
entry of MAPPINGS: an example of its paths, the schema to read it with and an expression for its turns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name

TURN = "struct<turn:bigint,role:string,text:string>"


def field_paths(record: Column) -> Column:
    """The nested field names of a JSON record without the types of its values; null where the text is not JSON."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(schema, r": (?!OBJECT|ARRAY)[A-Z]+(\(\d+,\s*\d+\))?(?=[,>])", "")


def schema_fingerprint(paths: Column) -> Column:
    return F.lower(F.hex(F.xxhash64(paths)))


@dataclass(frozen=True)
class Mapping:
    """paths: the layouts it reads, as field_paths gives them. schema: how the record is parsed. turns: record to array of
    (turn, role, text)."""

    name: str
    paths: tuple[str, ...]
    schema: str
    turns: Callable[[Column], Column]


def _turn(turn: Column, role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(turn.cast("bigint").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _numbered(items: Column, role: str, text: str) -> Column:
    return F.transform(items, lambda m, i: _turn(i, m[role], m[text]))


def _question_answer(question: Column, answer: Column, system: Column | None = None) -> Column:
    turns = [] if system is None else [_turn(F.lit(0), "system", system)]
    n = len(turns)
    return F.array(*turns, _turn(F.lit(n), "user", question), _turn(F.lit(n + 1), "assistant", answer))


def _role(name: Column) -> Column:
    """Role names of speaker layouts in canonical form; others stay."""
    return F.when(name.isin("human", "prompter"), "user").when(name.isin("gpt", "bot", "model"), "assistant").otherwise(name)


MAPPINGS = (
    Mapping("turn_row", ("OBJECT<conv_id, role, text, turn>",), "conv_id bigint, turn bigint, role string, text string",
            lambda r: F.array(_turn(r["turn"], r["role"], r["text"]))),
    Mapping("messages", ("OBJECT<messages: ARRAY<OBJECT<content, role>>>", "OBJECT<conv_id, messages: ARRAY<OBJECT<content, role>>>"),
            "messages array<struct<role:string,content:string>>", lambda r: _numbered(r["messages"], "role", "content")),
    Mapping("speakers", ("OBJECT<conversations: ARRAY<OBJECT<from, value>>>",), "conversations array<struct<from:string,value:string>>",
            lambda r: F.transform(r["conversations"], lambda m, i: _turn(i, _role(m["from"]), m["value"]))),
    Mapping("prompt", ("OBJECT<completion, prompt>",), "prompt string, completion string", lambda r: _question_answer(r["prompt"], r["completion"])),
    Mapping("prompt_response", ("OBJECT<prompt, response>", "OBJECT<prompt, response, system>"), "system string, prompt string, response string",
            lambda r: F.when(r["system"].isNull(), _question_answer(r["prompt"], r["response"])).otherwise(_question_answer(r["prompt"], r["response"], r["system"]))),
    Mapping("instruction", ("OBJECT<instruction, output>", "OBJECT<input, instruction, output>"), "instruction string, input string, output string",
            lambda r: _question_answer(F.concat(F.coalesce(r["instruction"], F.lit("")), F.when(F.coalesce(r["input"], F.lit("")) == "", "").otherwise(F.concat(F.lit("\n"), r["input"]))), r["output"])),
    Mapping("nested_data", ("OBJECT<data: OBJECT<answer, question>>", "OBJECT<data: OBJECT<answer, question>, meta: OBJECT<id>>"), "data struct<question:string,answer:string>",
            lambda r: _question_answer(r["data"]["question"], r["data"]["answer"])),
)


def canonical_turns(records: DataFrame, record: str = "record", id_column: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id, layout, fingerprint, turn, role, text): one row per turn of each JSON record.

    A record whose fingerprint no mapping has keeps one row with its fingerprint and null layout, turn, role and text, so
    unknown layouts are seen and none is lost; so does a record of a known layout without turns. Null roles and texts are empty.
    """
    paths, print_, layout, turns = (free_name(records, c) for c in ("_paths", "_print", "_layout", "_turns"))
    known = {m.name: [schema_fingerprint(F.lit(p)) for p in m.paths] for m in mappings}
    marked = records.withColumn(paths, field_paths(F.col(record))).withColumn(print_, schema_fingerprint(F.coalesce(paths, F.lit(""))))
    which, found = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for m in reversed(mappings):
        hit = F.lit(False)
        for p in known[m.name]:
            hit = hit | (F.col(print_) == p)
        which = F.when(hit, m.name).otherwise(which)
        found = F.when(hit, m.turns(F.from_json(F.col(record), m.schema)).cast(f"array<{TURN}>")).otherwise(found)
    rows = marked.withColumns({layout: which, turns: found})
    t = free_name(rows, "_t")
    rows = rows.withColumn(t, F.explode_outer(turns))
    return rows.select(F.col(id_column), F.col(layout).alias("layout"), F.col(print_).alias("fingerprint"), F.col(f"{t}.turn").alias("turn"), F.col(f"{t}.role").alias("role"), F.col(f"{t}.text").alias("text"))


# Control strings that no formatted text may hold, and what stands for their first character inside a text. The ampersand is
# escaped first and read back last, so every text comes back as it was.
OPEN, CLOSE = "<|turn|>", "<|end|>"
ESCAPES = (("&", "&amp;"), ("<|", "&lt;|"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("[INST]", "&lsqb;INST]"), ("[/INST]", "&lsqb;/INST]"))
PLAIN = (("&lt;", "<"), ("&lsqb;", "["), ("&#10;", "\n"), ("&amp;", "&"))


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for safe, raw in PLAIN:
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds ``formatted`` (the turn as it stands in the conversation's text), ``loss_from`` and ``loss_length``: the code points of
    it under the loss mask, which are those of an assistant's text. Turns are formatted one by one, so a conversation of any
    length needs no memory; its text is the formatted turns in order of turn, role and text.
    """
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    body = escape(F.col("text"))
    return turns.select("*", F.concat(head, body, F.lit(CLOSE)).alias("formatted"), F.char_length(head).cast("bigint").alias("loss_from"),
                        F.when(F.col("role") == "assistant", F.char_length(body)).otherwise(0).cast("bigint").alias("loss_length"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """Reads role and text back from ``formatted``, and ``loss_text`` from the code points under the mask, all unescaped."""
    inner = F.substring("formatted", F.lit(len(OPEN) + 1), F.char_length("formatted") - len(OPEN) - len(CLOSE))
    cut = F.instr(inner, "\n")
    lost = F.when(F.col("loss_length") > 0, F.substring("formatted", (F.col("loss_from") + 1).cast("int"), F.col("loss_length").cast("int"))).otherwise("")
    return formatted.select(
        *[c for c in formatted.columns if c not in ("role", "text")],
        unescape(F.substring(inner, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(inner, cut + 1, F.char_length(inner))).alias("text"), unescape(lost).alias("loss_text"))


def conversation_text(formatted: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """One row per conversation: its id and the whole formatted text. A conversation must fit into one value."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "formatted")))
    return formatted.groupBy(id_column).agg(F.array_join(F.transform(ordered, lambda t: t["formatted"]), "").alias("formatted"))


def conversation_digests(formatted: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted turns.

    Digests of a conversation's turns are sequential by definition: its turns, already read back and measured elsewhere, meet
    in one group to be joined. Turns are ordered by turn, role and text; a null conv_id is a conversation of its own.
    """
    back = read_turns(formatted).withColumn("chars", F.char_length("formatted").cast("bigint"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "loss_text")))
    grouped = back.groupBy(id_column).agg(F.count("*").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sum(F.char_length("loss_text")).alias("loss_chars"), ordered.alias("turns"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform("turns", lambda t: t["loss_text"]), "")
    return grouped.select(id_column, "n_turns", F.sha2(spoken, 256).alias("turns_sha256"), F.col("loss_chars").cast("bigint").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), "formatted_chars")
