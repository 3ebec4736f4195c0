"""Chat formatting of records in many layouts, all in DataFrame functions.

A record's layout is known by its fingerprint, a hash of the paths of the nested fields that hold a value.
Each fingerprint selects a declarative mapping (a `Layout`), which says where roles and texts stand; the
mapping turns the record into canonical turns.  Turns are then formatted by a template that marks them and
escapes its control strings inside roles and texts, so that the output reads back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let

TURN = "struct<turn:bigint,role:string,text:string>"


class Layout(NamedTuple):
    """Where a record keeps its turns.

    `turns` are (role, paths) pairs whose texts stand in fields of their own, joined by a blank line; or
    `each` names a list whose items have `role` and `text`; or, without both, the record is one turn.
    A record has the layout if it holds all paths but the `optional` ones, and no other path of any layout.
    """
    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    turn: str = ""
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        if self.turns:
            return [p for _, some in self.turns for p in some]
        if self.each:
            return [f"{self.each}[]", f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"]
        return [p for p in (self.turn, self.role, self.text) if p]

    def fingerprints(self) -> Iterator[str]:
        """The path lists that select this layout, one for each choice of optional paths."""
        paths = self.paths()
        for n in range(len(self.optional) + 1):
            for left_out in combinations(self.optional, n):
                yield ",".join(sorted(set(paths) - set(left_out)))


_SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("chatgpt", "assistant"))
LAYOUTS = (
    Layout("row", turn="turn", role="role", text="text", optional=("turn",)),
    Layout("messages", each="messages", role="role", text="content",
           optional=("messages[].role", "messages[].content")),
    Layout("speakers", each="conversations", role="from", text="value", roles=_SPEAKERS,
           optional=("conversations[].from", "conversations[].value")),
    Layout("prompt", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("request", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("question", turns=(("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",))), optional=("system",)),
    Layout("instruction", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
           optional=("system", "input")),
)


class Template(NamedTuple):
    """Control strings around the role and the text of a turn; none may hold a backslash, which escapes."""
    before: str = "<s>[INST] "
    between: str = " [/INST]\n"
    after: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")

    def escape(self, text: Column) -> Column:
        """Backslashes doubled and one put after the first character of every control string."""
        broken = "|".join(f"{_java(c[0])}(?={_java(c[1:])})" for c in self.controls)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), broken, r"$0\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


TEMPLATE = Template()


def _java(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def schema(layouts: tuple[Layout, ...] = LAYOUTS) -> T.StructType:
    """A record type with every path of the layouts, in which a JSON text is read."""
    fields: dict[str, T.DataType] = {}
    for layout in layouts:
        if layout.each:
            fields[layout.each] = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in (layout.role, layout.text)]))
        else:
            fields |= {p: T.LongType() if p == layout.turn else T.StringType() for p in layout.paths()}
    return T.StructType([T.StructField(c, t) for c, t in fields.items()])


def _present(record: Column, kind: T.StructType) -> dict[str, Column]:
    """Whether a record holds a value at each path of its type."""
    def item_holds(name: str):
        return lambda item: item[name].isNotNull()

    out: dict[str, Column] = {}
    for f in kind.fields:
        value = record[f.name]
        if isinstance(f.dataType, T.ArrayType):
            out[f"{f.name}[]"] = value.isNotNull()
            if isinstance(f.dataType.elementType, T.StructType):
                for g in f.dataType.elementType.fieldNames():
                    out[f"{f.name}[].{g}"] = F.exists(value, item_holds(g))
        elif isinstance(f.dataType, T.StructType):
            out |= {f"{f.name}.{p}": c for p, c in _present(value, f.dataType).items()}
        else:
            out[f.name] = value.isNotNull()
    return out


def fingerprint(record: Column, kind: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the paths, among those that any layout names, at which the record holds a value."""
    known = {p for layout in layouts for p in layout.paths()}
    held = sorted((p, c) for p, c in _present(record, kind).items() if p in known)
    return F.xxhash64(F.concat_ws(",", *[F.when(c, F.lit(p)) for p, c in held]) if held else F.lit(""))


def _mapped(layout: Layout, record: Column, kind: T.StructType) -> Column:
    """The canonical turns of a record of this layout."""
    have = set(kind.fieldNames())

    def value(path: str) -> Column:
        return (record[path] if path in have else F.lit(None)).cast("string")

    def named(role: Column) -> Column:
        role = F.coalesce(role.cast("string"), F.lit(""))
        return F.coalesce(*[F.when(F.lower(role) == a, b) for a, b in layout.roles], role) if layout.roles else role

    def turn(n: Column, role: Column, text: Column) -> Column:
        return F.struct(n.cast("long").alias("turn"), role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))

    if layout.turns:
        some = F.array(*[turn(F.lit(k), F.lit(role), F.concat_ws("\n\n", *[value(p) for p in paths]))
                         for k, (role, paths) in enumerate(layout.turns)])
        optional = [k for k, (_, paths) in enumerate(layout.turns) if set(paths) <= set(layout.optional)]
        gone = F.array(*[F.when(value(layout.turns[k][1][0]).isNull(), F.lit(k)).cast("long") for k in optional]) if optional else None
        return some if gone is None else F.filter(some, lambda t: ~F.coalesce(F.array_contains(gone, t["turn"]), F.lit(False)))
    if layout.each:
        if layout.each not in have:
            return F.lit(None).cast(f"array<{TURN}>")
        return F.transform(record[layout.each], lambda m, k: turn(k, named(m[layout.role]), m[layout.text]))
    n = record[layout.turn] if layout.turn in have else F.lit(None)
    return F.array(turn(n, named(value(layout.role)), value(layout.text)))


def canonical(records: DataFrame, id: str = "id", record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, layout, turn, role, text): one row a turn of every record; a record of no known layout gives one
    row with nulls.  `record` is a struct, or a JSON text (one that is no object has no layout)."""
    base = records.select(F.col(id).alias("id"), F.col(record).alias("record"))
    kind = base.schema["record"].dataType
    if not isinstance(kind, T.StructType):
        kind = schema(layouts)
        base = base.withColumn("record", F.from_json("record", kind))
    usable = [x for x in layouts if set(x.paths()) - set(x.optional) <= set(_present(F.col("record"), kind))]
    marked = base.withColumn("print", fingerprint(F.col("record"), kind, layouts))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for x in reversed(usable):
        hit = F.lit(False)
        for paths in x.fingerprints():
            hit = hit | (F.col("print") == F.xxhash64(F.lit(paths)))
        name = F.when(hit, F.lit(x.name)).otherwise(name)
        turns = F.when(F.col("layout") == x.name, _mapped(x, F.col("record"), kind)).otherwise(turns)
    some = marked.withColumn("layout", name).select("id", "layout", F.explode_outer(turns).alias("t"))
    return some.select("id", "layout", "t.turn", "t.role", "t.text")


def format_turns(turns: DataFrame, template: Template = TEMPLATE, learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(id, n_turns, formatted, loss_spans) per id of (id, turn, role, text) rows.

    Turns stand by `turn`, nulls first, then by role and text.  `loss_spans` are the places of the escaped
    texts of `learnt` roles in the output, in order: start and end in code points, byte_start and byte_end
    in UTF-8.  Null roles and texts are empty.  Places come from a running sum over rows, so a turn is
    handled once; a conversation's output is one value.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = turns.select("id", "turn", role.alias("role"), text.alias("text")).withColumns({
        "head": F.concat(F.lit(template.before), template.escape(F.col("role")), F.lit(template.between)),
        "body": template.escape(F.col("text"))})
    order = Window.partitionBy("id").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = len(template.after)
    placed = whole.select(
        "id", "role", F.concat("head", "body", F.lit(template.after)).alias("piece"), F.length("body").alias("n"), F.octet_length("body").alias("bytes"),
        F.sum((F.length("head") + F.length("body") + tail).cast("long")).over(order).alias("end"),
        F.sum((F.octet_length("head") + F.octet_length("body") + len(template.after.encode())).cast("long")).over(order).alias("byte_end"))
    end, byte_end = F.col("end") - tail, F.col("byte_end") - len(template.after.encode())
    span = F.struct((end - F.col("n")).alias("start"), end.alias("end"), (byte_end - F.col("bytes")).alias("byte_start"), byte_end.alias("byte_end"))
    out = placed.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("end", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("role").isin(*learnt), span))).alias("loss_spans"))
    return out.select("id", F.size("pieces").cast("long").alias("n_turns"),
                      F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss_spans")


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The (role, text) turns of a formatted text."""
    def read(piece: Column) -> Column:
        head, n = F.get(piece, F.lit(0)), len(template.before)
        return F.struct(template.unescape(F.substring(head, F.lit(n + 1), F.length(head) - n)).alias("role"),
                        template.unescape(F.get(piece, F.lit(1))).alias("text"))

    pieces = F.filter(F.split(formatted, _java(template.after)), lambda p: p != "")
    return F.transform(pieces, lambda p: let(F.split(p, _java(template.between), 2), read))


def read_loss(formatted: Column, spans: Column, template: Template = TEMPLATE) -> Column:
    """The unescaped texts under the loss mask, in order."""
    def cut(data: Column) -> Column:
        return F.transform(spans, lambda s: template.unescape(F.decode(
            F.substring(data, (s["byte_start"] + 1).cast("int"), (s["byte_end"] - s["byte_start"]).cast("int")), "UTF-8")))

    return let(F.encode(formatted, "UTF-8"), cut)


def format_records(records: DataFrame, id: str = "id", record: str = "record", template: Template = TEMPLATE,
                   layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Conversations of `records` in any of the layouts, formatted: (id, n_turns, formatted, loss_spans).

    Records of one id are one conversation, their turns in order of turn (of place, where the layout has
    none).  Records of no known layout are left out (`canonical` shows them).  Null and empty texts are empty
    turns, a null id is a conversation of its own, repeated rows are repeated turns.  An empty table gives an
    empty result; other columns are not carried.
    """
    turns = canonical(records, id, record, layouts).where("layout is not null and role is not null")
    return format_turns(turns, template).withColumnRenamed("id", id)
