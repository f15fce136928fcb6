"""Chat formatting by schema fingerprints.

A record's nested field paths are hashed; the hash names a layout, and the layout says in SQL expressions how its fields become turns
(role, text). Typed tables have one fingerprint, taken from their schema; JSON records have one each, taken from the record itself, so
prompt, instruction and message layouts may stand mixed in one column. DataFrame functions only.

Turns are written between marks of a template. Marks inside texts and roles are broken up by a backslash after their first character
(and backslashes doubled), so a mark in the output is always the template's own, and reading back gives the texts as they were.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, staged

NEW_LINE = "\n"


@dataclass(frozen=True)
class Layout:
    """Paths of a layout and what its fields mean. ``{path:type}`` in an expression stands for the field at that path.

    ``turns`` gives an array of (role, text), in order; where a record is a single turn, ``turn`` gives its place among those of its
    conversation. Each of ``optional`` is a group of paths that may be missing together.
    """

    name: str
    paths: tuple[str, ...]
    conv_id: str
    turns: str
    turn: str | None = None
    optional: tuple[tuple[str, ...], ...] = ()

    def fingerprints(self) -> list[str]:
        gone = itertools.chain.from_iterable(itertools.combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [fingerprint(set(self.paths) - set(itertools.chain(*groups))) for groups in gone]


def _layouts(key: str) -> tuple[Layout, ...]:
    who, pairs = "{%s:bigint}" % key, "array<struct<role:string,content:string>>"
    return (
        Layout("turn rows", (key, "turn", "role", "text"), who, "array(named_struct('role', {role:string}, 'text', {text:string}))", "{turn:bigint}"),
        Layout("messages", (key, "messages", "messages[]", "messages[].content", "messages[].role"), who,
               "transform({messages:%s}, m -> named_struct('role', m.role, 'text', m.content))" % pairs),
        Layout("from and value", (key, "conversations", "conversations[]", "conversations[].from", "conversations[].value"), who,
               "transform({conversations:array<struct<from:string,value:string>>}, m -> named_struct('role', "
               "CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END, 'text', m.value))"),
        Layout("prompt and response", (key, "prompt", "response"), who,
               "array(named_struct('role', 'user', 'text', {prompt:string}), named_struct('role', 'assistant', 'text', {response:string}))"),
        Layout("prompt messages and response", (key, "prompt", "prompt[]", "prompt[].content", "prompt[].role", "response"), who,
               "concat(transform({prompt:%s}, m -> named_struct('role', m.role, 'text', m.content)), array(named_struct('role', 'assistant', 'text', {response:string})))" % pairs),
        Layout("instruction", (key, "instruction", "input", "output", "system"), who,
               "filter(array(named_struct('role', 'system', 'text', {system:string}), named_struct('role', 'user', 'text', "
               "concat_ws('\\n', {instruction:string}, nullif({input:string}, ''))), named_struct('role', 'assistant', 'text', {output:string})), "
               "m -> m.role <> 'system' OR m.text IS NOT NULL)", optional=(("input",), ("system",))),
    )


LAYOUTS = _layouts("conv_id")


def fingerprint(paths) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Every nested field path of a type: ``a``, ``a.b``, and ``a[]`` for what stands in an array."""
    own = [at] if at else []
    if isinstance(kind, T.StructType):
        name = lambda n: n if re.fullmatch(r"\w*[A-Za-z_]\w*", n, re.ASCII) else "`" + n.replace("`", "``") + "`"
        return own + [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{name(f.name)}" if at else name(f.name))]
    if isinstance(kind, T.ArrayType):
        return own + schema_paths(kind.elementType, at + "[]")
    return own


def record_paths(record: Column) -> Column:
    """The nested field paths of each variant value, sorted; null where there is none."""
    tokens = F.regexp_extract_all(F.call_function("schema_of_variant", record), F.lit(r"(?:`(?:[^`]|``)*`|\w+): |OBJECT<|ARRAY<|>|[A-Z_]+(?:\(\d+, ?\d+\))?"), F.lit(0))
    start = F.expr("named_struct('open', CAST(array() AS array<string>), 'at', '', 'paths', CAST(array() AS array<string>))")

    def step(acc: Column, token: Column) -> Column:
        top = F.coalesce(F.try_element_at(acc["open"], F.lit(-1)), F.lit(""))
        name = F.substring(token, F.lit(1), F.length(token) - 2)
        opened, array = token.isin("OBJECT<", "ARRAY<"), F.concat(acc["at"], F.lit("[]"))
        at = (F.when(token.endswith(": "), F.concat(top, F.when(top == "", F.lit("")).otherwise(F.lit(".")), name))
              .when(token == "ARRAY<", array).otherwise(acc["at"]))
        return F.struct(
            F.when(opened, F.array_append(acc["open"], at)).when(token == ">", F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0)))).otherwise(acc["open"]).alias("open"),
            at.alias("at"),
            # what stands in an array has its path from the bracket, whether it is an object or a value
            F.when(opened | (~token.endswith(": ") & (token != ">")), F.concat(acc["paths"], F.when(token == "ARRAY<", F.array(acc["at"], array)).otherwise(F.array(acc["at"])))).otherwise(acc["paths"]).alias("paths"),
        )

    return F.array_sort(F.array_distinct(F.filter(F.aggregate(tokens, start, step)["paths"], lambda p: p != "")))


def record_fingerprint(record: Column) -> Column:
    return F.md5(F.encode(F.array_join(record_paths(record), NEW_LINE), "UTF-8"))


def _filled(expression: str, record: str | None) -> Column:
    get = (lambda p, t: f"try_variant_get({record}, '$.{p}', '{t}')") if record else (lambda p, t: f"CAST({p} AS {t})")
    return F.expr(re.sub(r"\{(\w+):([^{}]+)\}", lambda m: get(m[1], m[2]), expression))


def _turns(df: DataFrame, layout: str | Column, conv_id: Column, turn: Column, turns: Column) -> DataFrame:
    name = F.lit(layout) if isinstance(layout, str) else layout
    whole = df.select(conv_id.alias("conv_id"), turn.alias("at"), name.alias("layout"), turns.alias("turns"))
    return whole.select("conv_id", "at", "layout", F.posexplode("turns").alias("place", "own")).select(
        "conv_id", F.coalesce("at", F.col("place").cast("bigint")).alias("turn"), F.col("own.role").alias("role"), F.col("own.text").alias("text"), "layout")


def turns_of_table(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text, layout from a typed table; its schema's fingerprint picks the layout.

    A schema with further columns is reduced to the first layout it holds whole. None fits: ValueError. An empty table gives no turns.
    """
    known = {f: layout for layout in layouts for f in layout.fingerprints()}
    layout = known.get(fingerprint(schema_paths(df.schema)))
    if layout is None:
        have = set(schema_paths(df.schema))
        layout = next((x for x in layouts if have >= set(x.paths)), None)
        if layout is None:
            raise ValueError(f"no layout for the field paths {sorted(have)}")
    if layout.turn is None:
        return _turns(df, layout.name, _filled(layout.conv_id, None), F.lit(None).cast("bigint"), _filled(layout.turns, None))
    own = _filled(layout.turns, None)[0]
    return df.select(_filled(layout.conv_id, None).alias("conv_id"), _filled(layout.turn, None).alias("turn"), own["role"].alias("role"), own["text"].alias("text"), F.lit(layout.name).alias("layout"))


def turns_of_records(df: DataFrame, json_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text, layout from JSON records of mixed layouts; each record's own fingerprint picks its layout.

    Records whose fingerprint no layout has, broken ones and nulls give one row with a null layout, turn, role and text each, so that
    they can be counted; ``format_chats`` leaves such rows out. A record whose layout fits but that has no turns gives no row.
    """
    read = df.select(F.expr(f"try_parse_json(`{json_col}`)").alias("record"))
    named = read.withColumn("print", record_fingerprint(F.col("record")))

    def case(of) -> Column:
        out = None
        for layout in layouts:
            value = of(layout)
            if value is not None:
                hit = F.col("print").isin(layout.fingerprints())
                out = F.when(hit, value) if out is None else out.when(hit, value)
        return out

    unknown = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))
    name = case(lambda x: F.lit(x.name))
    out = _turns(named, name, F.coalesce(case(lambda x: _filled(x.conv_id, "record")), F.expr("try_variant_get(record, '$.conv_id', 'bigint')")),
                 case(lambda x: _filled(x.turn, "record") if x.turn else None), case(lambda x: _filled(x.turns, "record")).otherwise(unknown))
    return out.withColumn("turn", F.when(F.col("layout").isNotNull(), F.col("turn")))


@dataclass(frozen=True)
class Template:
    """Marks around turns. No mark may hold, after its start, a character that a mark starts with, nor a backslash."""

    begin: str = "<s>"
    roles: dict = field(default_factory=lambda: {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("[OUT]", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        starts = {m[0] for m in self.marks}
        if any(len(m) < 2 or "\\" in m or starts & set(m[1:]) for m in self.marks):
            raise ValueError("marks would run into each other")

    @property
    def marks(self) -> list[str]:
        return [self.begin, *itertools.chain(*self.roles.values()), *self.other]

    def escaped(self, text: Column) -> Column:
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for mark in dict.fromkeys(self.marks):
            text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
        return text

    @staticmethod
    def unescaped(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def opening(self, role: Column) -> Column:
        out = F.concat(F.lit(self.other[0]), self.escaped(role), F.lit(self.other[1]))
        for name, (mark, _) in self.roles.items():
            out = F.when(role == name, F.lit(mark)).otherwise(out)
        return out

    def closing(self, role: Column) -> Column:
        out = F.lit(self.other[2])
        for name, (_, mark) in self.roles.items():
            out = F.when(role == name, F.lit(mark)).otherwise(out)
        return out


def format_chats(turns: DataFrame, template: Template | None = None, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """The keys, n_turns, formatted (string) and mask per conversation; ``mask`` lists the stretches to learn, in UTF-8 bytes of ``formatted``.

    Turns stand by ``turn`` (nulls first), ties by role and text; repeated rows are turns of their own. Null roles and texts count as empty. Null
    keys are a key. Roles the template does not know are written out. No turns: no rows. A conversation is one output string, so one
    task must hold the longest; its turns are sorted on the way there, not hashed.
    """
    t = template or Template()
    prepare(turns.sparkSession)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    known = turns.where("layout IS NOT NULL") if "layout" in turns.columns else turns
    parts = known.select(*keys, "turn", role.alias("role"), text.alias("text"), t.opening(role).alias("open"), t.escaped(text).alias("body"), t.closing(role).alias("close"))
    size = lambda c: F.octet_length(c).cast("bigint")
    order = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.coalesce(F.sum(size("open") + size("body") + size("close")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.select(*keys, F.row_number().over(order).alias("at"), F.concat("open", "body", "close").alias("whole"),
                          F.when(F.col("role").isin(*t.learned), F.struct((before + len(t.begin.encode()) + size("open")).alias("start"), size("body").alias("length"))).alias("span"))
    own = F.array_sort(F.collect_list(F.struct("at", "whole", "span")))
    return placed.groupBy(*keys).agg(F.count("*").alias("n_turns"), own.alias("own")).select(
        *keys, "n_turns", F.concat(F.lit(t.begin), F.array_join(F.col("own.whole"), "")).alias("formatted"),
        F.filter(F.col("own.span"), lambda s: s.isNotNull()).alias("mask"))


def read_chats(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """``chats`` with its turns (role, text) and the learned text, both read from ``formatted`` and ``mask`` alone."""
    t = template or Template()
    closes = sorted({m[1] for m in t.roles.values()} | {t.other[2]})
    body = F.substring(F.col("formatted"), F.lit(len(t.begin) + 1), F.length("formatted"))
    pieces = F.filter(F.split(body, "|".join(map(re.escape, closes))), lambda x: x != "")

    def turn(piece: Column) -> Column:
        after = lambda mark: F.substring(piece, F.lit(len(mark) + 1), F.length(piece))
        named = F.split(after(t.other[0]), re.escape(t.other[1]), 2)
        role, text = t.unescaped(named[0]), named[1]
        for name, (mark, _) in t.roles.items():
            role, text = F.when(piece.startswith(mark), F.lit(name)).otherwise(role), F.when(piece.startswith(mark), after(mark)).otherwise(text)
        return F.struct(role.alias("role"), t.unescaped(text).alias("text"))

    raw = F.col("formatted").cast("binary")
    learned = F.transform("mask", lambda m: t.unescaped(F.decode(F.substring(raw, (m["start"] + 1).cast("int"), m["length"].cast("int")), "UTF-8")))
    return chats.withColumn("turns", F.transform(pieces, turn)).withColumn("learned", F.array_join(learned, ""))


def op12_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -1, formatted, written, and read back from what was written."""
    prepare(spark)
    own = '{"conv_id": -1, "messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'
    table = turns_of_table(spark.read.parquet(f"{folder}/conversations.parquet"))
    record = turns_of_records(spark.range(1).select(F.lit(own).alias("record")), "record")
    turns = table.withColumn("batch", F.lit(0)).unionByName(record.withColumn("batch", F.lit(1)))
    back = read_chats(staged(format_chats(turns, keys=("batch", "conv_id")), "chats"))
    sha = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit(NEW_LINE), x["text"], F.lit(NEW_LINE)))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), sha(F.array_join(lines, "")).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), sha(F.col("learned")).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


_ESCAPED = "replace({0}, '\\', '\\\\')"
for _mark in dict.fromkeys(Template().marks):
    _ESCAPED = f"replace({_ESCAPED}, '{_mark}', '{_mark[0]}\\{_mark[1:]}')"
SQL = f"""
WITH own AS (SELECT 0 AS batch, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
             UNION ALL VALUES (1, -1, 0, 'user', '</s>[INST] ok [/INST]'), (1, -1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (SELECT *, length({_ESCAPED.format('text')}) + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 9
                 ELSE 19 + length({_ESCAPED.format('role')}) END AS n FROM own)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, (3 + sum(n))::bigint AS formatted_chars
FROM sized GROUP BY batch, conv_id
"""
