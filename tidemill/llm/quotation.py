"""Quotation linking: quoted passages of messages are linked to the messages they come from.

1. Lines of a message are parsed: the number of `>` marks at a line's start (spaces between allowed) is its quote
   level; lines of level 0 are the message's own words, runs of lines of one level above 0 are quoted passages. A line
   of own words that announces a quote ("On ... wrote:", see ANNOUNCES) right before one goes with it.
2. Passages and own words are normalised (lower case, runs of white space and punctuation as one space) and cut into
   units: the whole, its lines and its sentences. Units are hashed; each quoted unit weighs as many as its words.
3. The first message that has a unit as own words is the unit's original: first in the same conversation (it must come
   before the quoting message), else in another (of the smallest conv_id; the two smallest are kept, as one may be the
   message's own). Both are aggregates, so a unit that a third of all messages share is one row on that side, and the
   join to quoted units stays proportional to those.
4. What a message replies to is told by its quotes of the lowest level that lead to a message of its own conversation:
   deeper ones are what that message quoted in turn. Of that level, it replies to the message that its quotes weigh most
   for (ties: the latest); without such a one, to the message before it. Messages are numbered by turn (then role, text):
   an order in which each reply comes after what it replies to.

Numbers within a conversation come from counts per (conversation, block of turns) and numbers within a block, so a
conversation of any length is spread. Messages without a conversation id, or without a turn, keep their words without
quotes, but have no position and no parent. A null text counts as empty. Repeated rows are messages of their own;
equal ones share their parent. A unit quoted at several levels counts at the lowest. A very long text is one row of its
task, at some twenty times its size. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.common import ship, slices, store

MARKS = re.compile(r"^(?:[ \t]*>)+[ \t]?")
ANNOUNCES = re.compile(r"^\s*(?:(?:on|am|le|el)\b.*(?:wrote|schrieb|a écrit|escribió)\b.*|-+ ?original message ?-+):?\s*$", re.IGNORECASE)
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """Own words, and the quoted passages with their levels."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    level = 0
    for line in (text or "").splitlines():
        m = MARKS.match(line)
        now = m.group().count(">") if m else 0
        rest = line[m.end() :] if m else line
        if now:
            if not level and own and ANNOUNCES.match(own[-1]):
                own.pop()
            if now != level:
                passages.append((now, []))
            passages[-1][1].append(rest)
        else:
            own.append(rest)
        level = now
    return "\n".join(own).strip() if passages else (text or ""), [(n, "\n".join(p)) for n, p in passages]


def units(text: str) -> dict[bytes, int]:
    """Hashes of the normalised whole, lines and sentences, with their numbers of words."""
    out: dict[bytes, int] = {}
    for piece in [text, *text.split("\n"), *SENTENCE.split(text.replace("\n", " "))]:
        words = WORD.findall(piece.lower())
        if words:
            out[hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()] = len(words)
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            own, levels, passages, own_units, quoted, weights, depths = [], [], [], [], [], [], []
            for text in part.column("text").to_pylist():
                words, found = parse(text)
                own.append(words)
                levels.append([n for n, _ in found])
                passages.append([p for _, p in found])
                own_units.append(list(units(words)))
                q: dict[bytes, tuple[int, int]] = {}
                for n, p in sorted(found, key=lambda f: -f[0]):  # the lowest level last, so that it stays
                    q |= {u: (w, n) for u, w in units(p).items()}
                quoted.append(list(q))
                weights.append([w for w, _ in q.values()])
                depths.append([n for _, n in q.values()])
            cols = [pa.array(own, pa.string()), pa.array(levels, pa.list_(pa.int32())), pa.array(passages, pa.list_(pa.string())), pa.array(own_units, pa.list_(pa.binary())), pa.array(quoted, pa.list_(pa.binary())), pa.array(weights, pa.list_(pa.int32())), pa.array(depths, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("conv_id", "turn", "role", "key")), *cols], ["conv_id", "turn", "role", "key", "own", "levels", "passages", "own_units", "quoted", "weights", "depths"])


def link_quotations(messages: DataFrame, block: int = 256) -> DataFrame:
    """Per message: conv_id, turn, role, text (own words), position, parent_turn, quote_levels, passages, linked_words
    (weight of the quotes that led to the parent), source_conv_id and source_turn (where the quotes weigh most for a
    message of another conversation)."""
    ship(messages.sparkSession)
    keyed = messages.select("conv_id", "turn", "role", F.unhex(F.md5(F.encode(F.concat_ws("|", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), "UTF-8"))).alias("key"), "text")
    parsed = store(keyed.mapInArrow(_parse, "conv_id long, turn long, role string, key binary, own string, levels array<int>, passages array<string>, own_units array<binary>, quoted array<binary>, weights array<int>, depths array<int>"), "parsed")
    placed = parsed.filter("conv_id is not null and turn is not null")

    message = ["conv_id", "turn", "key"]
    quoted = placed.filter("size(quoted) > 0").select(*message, F.explode(F.arrays_zip("quoted", "weights", "depths")).alias("q"))
    quoted = quoted.select(*message, F.col("q.quoted").alias("unit"), F.col("q.weights").alias("w"), F.col("q.depths").alias("depth")).distinct()
    here = placed.select("conv_id", "turn", F.explode("own_units").alias("unit")).groupBy("conv_id", "unit").agg(F.min("turn").alias("source"))
    here = here.join(quoted.select("unit").distinct(), "unit", "left_semi")
    near = quoted.join(here, ["conv_id", "unit"]).filter("source < turn")
    weighed = near.groupBy(*message, "depth", "source").agg(F.sum("w").alias("w"))
    parents = weighed.groupBy(*message).agg(F.max(F.struct((-F.col("depth")).alias("level"), "w", "source")).alias("best"))

    place = F.struct("conv_id", F.col("source").alias("turn"))
    first = here.groupBy("unit").agg(F.min(place).alias("any"))
    second = here.join(first, "unit").filter("conv_id <> any.conv_id").groupBy("unit").agg(F.min(place).alias("next"))
    rest = quoted.join(near.select(*message, "unit"), [*message, "unit"], "left_anti").join(first, "unit").join(second, "unit", "left")
    rest = rest.withColumn("any", F.when(F.col("any.conv_id") == F.col("conv_id"), F.col("next")).otherwise(F.col("any"))).filter("any is not null")
    others = rest.groupBy(*message, "any").agg(F.sum("w").alias("w")).groupBy(*message).agg(F.max(F.struct("w", "any")).alias("far"))

    blocks = placed.groupBy("conv_id", F.floor(F.col("turn") / block).alias("b")).agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    along = W.partitionBy("conv_id").orderBy("b")
    blocks = blocks.select("conv_id", "b", (F.sum("n").over(along) - F.col("n")).alias("before"), F.lag("last").over(along).alias("last"))
    inside = W.partitionBy("conv_id", "b").orderBy("turn", "role", "key")
    numbered = placed.withColumn("b", F.floor(F.col("turn") / block)).withColumn("n", F.row_number().over(inside)).withColumn("previous", F.lag("turn").over(inside))
    numbered = numbered.join(blocks, ["conv_id", "b"]).join(parents, ["conv_id", "turn", "key"], "left").join(others, ["conv_id", "turn", "key"], "left")
    columns = ["conv_id", "turn", "role", F.col("own").alias("text")]
    linked = numbered.select(
        *columns, (F.col("before") + F.col("n") - 1).alias("position"), F.coalesce("best.source", "previous", "last").alias("parent_turn"),
        F.col("levels").alias("quote_levels"), "passages", F.coalesce("best.w", F.lit(0)).cast("long").alias("linked_words"), F.col("far.any.conv_id").alias("source_conv_id"), F.col("far.any.turn").alias("source_turn"),
    )
    none = F.lit(None).cast("long")
    apart = parsed.filter("conv_id is null or turn is null").select(*columns, none.alias("position"), none.alias("parent_turn"), F.col("levels").alias("quote_levels"), "passages", F.lit(0).cast("long").alias("linked_words"), none.alias("source_conv_id"), none.alias("source_turn"))
    return linked.unionByName(apart)


def op1(spark, sf_dir: str) -> DataFrame:
    out = link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "turn", "role", "text", "position", "parent_turn", F.size("passages").alias("n_passages"), "linked_words", "source_conv_id", "source_turn")
