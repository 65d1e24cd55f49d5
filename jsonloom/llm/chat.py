"""Chat formatting by schema fingerprints, in DataFrame operations only.

Records come in many layouts, as one table whose layout columns are null where a record does not use them (what
``spark.read.json`` makes of mixed files). The nested field paths that a record uses are hashed; the hash selects one of
LAYOUTS, which says declaratively how its fields become canonical (role, text) turns. Turns are then written as

    [INST]role[/INST]text</s>

with one backslash put inside any control string in a role or text, so that the output can be parsed back exactly.

Defined results: a null role or text is empty; a record whose paths match no layout, or without turns, has layout null
and no output turns; records that share an id, or are alike, each become a chat of their own; in the query, which gathers rows by
turn, repeated rows count as turns of their own, and turns with equal numbers are ordered by role, then text. A null id stays null;
an empty table gives no rows; columns that no layout names are not read, so their names can't clash. A conversation is one value in
the output and so must fit in one row (2 GB), however long its texts are or many its turns.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jsonloom.functions.values import let

OPEN, SPLIT, CLOSE = "[INST]", "[/INST]", "</s>"
#: Turns whose lengths are added one by one.
BLOCK = 256
#: A control string, perhaps with backslashes inside from an earlier escape.
CONTROL = r"(</?|\[/?)(\\*)(s>|INST\])"
ESCAPED = r"(</?|\[/?)\\(\\*)(s>|INST\])"

#: Each layout: the paths that it uses, and its turns as (role, path), or a list of structs with its role and text fields.
LAYOUTS = [
    {"name": "prompt", "turns": [("user", "prompt"), ("assistant", "completion")]},
    {"name": "instruction", "turns": [("user", "instruction"), ("assistant", "output")]},
    {"name": "question", "turns": [("system", "system_prompt"), ("user", "question"), ("assistant", "response")]},
    {"name": "messages", "list": "messages", "role": "role", "text": "content", "roles": {}},
    {"name": "share", "list": "conversations", "role": "from", "text": "value", "roles": {"human": "user", "gpt": "assistant"}},
]
TURNS = "array<struct<role:string,text:string>>"


def layout_paths(layout: dict) -> list[str]:
    if "list" in layout:
        return sorted(f"{layout['list']}[].{layout[k]}" for k in ("role", "text"))
    return sorted(path for _, path in layout["turns"])


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def used_paths(schema: T.StructType, at: str = "", shown: str = "") -> list[tuple[str, Column]]:
    """The leaf paths under a schema, each with the condition that a record uses it."""
    out = []
    for field in schema.fields:
        column, path, kind = f"{at}`{field.name}`", f"{shown}{field.name}", field.dataType
        if isinstance(kind, T.StructType):
            out += used_paths(kind, f"{column}.", f"{path}.")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            out += [(f"{path}[].{x.name}", F.col(column).isNotNull()) for x in kind.elementType.fields]
        else:
            out.append((path, F.col(column).isNotNull()))
    return out


def schema_fingerprint(schema: T.StructType) -> Column:
    """The hash of a record's sorted leaf paths."""
    paths = [F.when(used, F.lit(path)) for path, used in sorted(used_paths(schema), key=lambda x: x[0])]
    return F.sha2(F.array_join(F.array_compact(F.array(*paths)), "\n"), 256)


def _turns(layout: dict, fields: set[str]) -> Column | None:
    if "list" in layout:
        if layout["list"] not in fields:
            return None
        names = F.create_map(*[F.lit(x) for pair in layout["roles"].items() for x in pair]) if layout["roles"] else None

        def turn(x: Column) -> Column:
            role = F.coalesce(x[layout["role"]], F.lit(""))
            role = role if names is None else F.coalesce(F.try_element_at(names, role), role)
            return F.struct(role.alias("role"), F.coalesce(x[layout["text"]], F.lit("")).alias("text"))

        return F.transform(F.col(f"`{layout['list']}`"), turn).cast(TURNS)
    if not {path for _, path in layout["turns"]} <= fields:
        return None
    return F.array(*[F.struct(F.lit(role).alias("role"), F.col(f"`{path}`").alias("text")) for role, path in layout["turns"]]).cast(TURNS)


def canonical_turns(records: DataFrame, record_id: str, layouts: list[dict] = LAYOUTS) -> DataFrame:
    """record_id, layout and turns of each record; columns that no layout names are left aside."""
    wanted = {x.split("[]")[0].split(".")[0] for layout in layouts for x in layout_paths(layout)}
    schema = T.StructType([x for x in records.schema.fields if x.name in wanted])
    fields = set(schema.fieldNames())
    print_ = schema_fingerprint(schema)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        if (made := _turns(layout, fields)) is not None:
            fits = F.col("__fingerprint") == fingerprint(layout_paths(layout))
            name, turns = F.when(fits, F.lit(layout["name"])).otherwise(name), F.when(fits, made).otherwise(turns)
    return records.withColumn("__fingerprint", print_).select(F.col(f"`{record_id}`").alias("record_id"), name.alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _starts(lengths: Column) -> Column:
    """The sum of the numbers before each. Sums of whole blocks come first, so that many turns don't cost their square."""
    block = F.lit(BLOCK)

    def summed(n: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.greatest(F.size(n) - 1, F.lit(0)), block)
        sums = F.transform(firsts, lambda i: _sum(F.slice(n, i + 1, BLOCK)))
        heads = let(sums, lambda s: F.transform(s, lambda _, i: _sum(F.slice(s, F.lit(1), i))))
        return let(heads, lambda h: F.transform(n, lambda _, i: F.get(h, F.floor(i / block).cast("int")) + _sum(F.slice(n, F.floor(i / block).cast("int") * block + 1, i % block))))

    return let(lengths, summed)


def formatted(canonical: DataFrame) -> DataFrame:
    """record_id, formatted text, and for each turn its start, and the start and length of what the loss covers (in code points).
    Each record is formatted in its row; nothing is shuffled."""

    def segment(x: Column) -> Column:
        text = F.concat(F.lit(OPEN), x["r"], F.lit(SPLIT), x["t"], F.lit(CLOSE))
        return F.struct(text.alias("segment"), (F.length(x["r"]) + len(OPEN + SPLIT)).cast("long").alias("head"), F.when(x["role"] == "assistant", F.length(x["t"])).otherwise(0).cast("long").alias("loss"))

    def chat(segments: Column) -> Column:
        starts = _starts(F.transform(segments, lambda x: F.length(x["segment"]).cast("long")))
        masks = F.zip_with(segments, starts, lambda x, start: F.struct(start.alias("start"), (start + x["head"]).alias("loss_start"), x["loss"].alias("loss_length")))
        return F.struct(F.array_join(segments["segment"], "").alias("formatted"), masks.alias("masks"))

    escaped_ = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), escaped(F.coalesce(x["role"], F.lit(""))).alias("r"), escaped(F.coalesce(x["text"], F.lit(""))).alias("t")))
    made = canonical.where(F.size("turns") > 0).select("record_id", let(F.transform(escaped_, segment), chat).alias("__chat"))
    return made.select("record_id", "__chat.formatted", "__chat.masks")


def parsed(chats: DataFrame) -> DataFrame:
    """What formatted() wrote, read back: record_id, turns and loss_texts (unescaped), by the masks alone."""
    segments = F.slice(F.split("formatted", CLOSE), 1, F.size("masks"))

    def turn(x: Column) -> Column:
        head = F.substring_index(x, SPLIT, 1)
        role = F.substr(head, F.lit(len(OPEN) + 1))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(x, F.length(head) + len(SPLIT) + 1)).alias("text"))

    def loss(x: Column, m: Column) -> Column:
        return F.when(m["loss_length"] > 0, unescaped(F.substr(x, (m["loss_start"] - m["start"] + 1).cast("int"), m["loss_length"].cast("int")))).otherwise("")

    return chats.withColumn("segments", segments).select("record_id", "formatted", F.transform("segments", turn).alias("turns"), F.zip_with("segments", "masks", loss).alias("loss_texts"))


# ---- query ----

PROBE = "</s>[INST] ok [/INST]"
KNOWN = ("system", "user", "assistant")


def mixed_records(conversations: DataFrame) -> DataFrame:
    """Conversations as records in all five layouts, by their shape and id."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    roles, text, even = F.col("turns.role"), F.col("turns.text"), F.coalesce(F.col("conv_id") % 2, F.lit(0)) == 0
    pair, triple = roles == F.array(*map(F.lit, KNOWN[1:])), roles == F.array(*map(F.lit, KNOWN))
    shape = F.when(pair, F.when(even, "prompt").otherwise("instruction")).when(triple, F.lit("question"))
    shape = F.when(shape.isNotNull(), shape).when(F.forall(roles, lambda r: r.isin(*KNOWN)) & ~even, "share").otherwise("messages")

    def put(layout: str, value: Column, name: str) -> Column:
        return F.when(F.col("shape") == layout, value).alias(name)

    at = lambda i: F.get(text, F.lit(i))
    return rows.withColumn("shape", shape).select(
        "conv_id", put("prompt", at(0), "prompt"), put("prompt", at(1), "completion"), put("instruction", at(0), "instruction"), put("instruction", at(1), "output"),
        put("question", at(0), "system_prompt"), put("question", at(1), "question"), put("question", at(2), "response"),
        put("messages", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))), "messages"),
        put("share", F.transform("turns", lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value"))), "conversations"),
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table plus conversation -1, whose texts are control strings."""
    spark = conversations.sparkSession
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text")) for i, r in enumerate(KNOWN[1:])])).alias("x"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe.select("conv_id", "x.*"))


def digests(conversations: DataFrame) -> DataFrame:
    back = parsed(formatted(canonical_turns(mixed_records(with_probe(conversations)), "conv_id")))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col("record_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(role, '(</?|\[/?)(\\*)(s>|INST\])', '\1\2\\\3', 'g') AS r, regexp_replace(text, '(</?|\[/?)(\\*)(s>|INST\])', '\1\2\\\3', 'g') AS t FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(t) + 17) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
