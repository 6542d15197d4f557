"""Conversations packed into chunks for a reader with a limited budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.schema import CHUNKS

BUDGET = 28_000
OVERLAP = 5


def boilerplate(items: DataFrame, least: int = 5) -> DataFrame:
    """(line, items) of the lines that are in ``least`` items or more."""
    lines = items.select("id", F.explode(F.split("body", "\n")).alias("line")).select("id", F.trim("line").alias("line")).where("line <> ''").distinct()
    return lines.groupBy("line").agg(F.count("*").alias("items")).where(F.col("items") >= least)


def without_boilerplate(items: DataFrame, lines: DataFrame) -> DataFrame:
    """bodies without boilerplate lines. The lines are joined, not broadcast: their number grows with the corpus."""
    long = items.select("id", F.posexplode(F.split("body", "\n")).alias("k", "text"))
    kept = long.join(lines.select(F.col("line").alias("__line")), F.trim("text") == F.col("__line"), "left_anti")
    bodies = kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n").alias("__body"))
    return items.join(bodies, "id", "left").withColumn("body", F.coalesce("__body", F.lit(""))).drop("__body")


def with_conversation(items: DataFrame) -> DataFrame:
    """An item without a conversation is one of its own."""
    return items.withColumn("conversation_id", F.coalesce(F.nullif("conversation_id", F.lit("")), F.concat(F.lit("__solo_"), "id")))


def participants(items: DataFrame) -> DataFrame:
    """(conversation_id, key, pid, ...) numbered p1, p2 ... by first appearance in time."""
    rows = items.select("conversation_id", "timestamp", "pos", F.posexplode("participants").alias("k", "p")).withColumn("key", T.party_key(F.col("p"))).where("key <> ''")
    when = F.struct(F.col("timestamp").isNull().alias("unknown"), "timestamp", "pos", "k")
    first = rows.groupBy("conversation_id", "key").agg(F.min_by("p", when).alias("p"), F.min(when).alias("first"))
    named = first.withColumn("n", F.row_number().over(Window.partitionBy("conversation_id").orderBy("first")))
    shown = F.coalesce(F.nullif("p.display_name", F.lit("")), F.nullif("p.id_value", F.lit("")), F.nullif("p.raw", F.lit("")), "key")
    return named.select("conversation_id", "key", F.concat(F.lit("p"), "n").alias("pid"), shown.alias("shown"), F.col("p.kind").alias("kind"), F.array_join("p.descriptors", "; ").alias("descriptors"))


def participant_tables(named: DataFrame) -> DataFrame:
    """(conversation_id, participant_table); rows are sorted as strings, p10 before p2."""
    row = F.struct("pid", F.concat("pid", F.lit(" | "), "shown", F.lit(" | "), "kind", F.lit(" | "), F.coalesce("descriptors", F.lit(""))).alias("row"))
    listed = named.groupBy("conversation_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    head = F.array(F.lit("## Participants"), F.lit("pid | display_name | kind | descriptors"), F.lit("----|--------------|------|------------"))
    return listed.select("conversation_id", F.array_join(F.concat(head, F.transform("rows", lambda r: r["row"])), "\n").alias("participant_table"))


def message_lines(items: DataFrame, named: DataFrame) -> DataFrame:
    """each item as a line without its local id: time, sender, receivers, body on one line cut at 1200."""
    who = named.select("conversation_id", "key", "pid")
    long = items.select("id", "conversation_id", F.posexplode("participants").alias("k", "p"))
    known = long.select("id", "conversation_id", "k", F.col("p.role").alias("role"), T.party_key(F.col("p")).alias("key")).join(who, ["conversation_id", "key"], "left")
    sender = known.where("role = 'sender'").groupBy("id").agg(F.min_by(F.coalesce("pid", F.lit("p?")), "k").alias("sender"))
    to = known.where("role in ('recipient', 'cc') and key <> ''").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("pid", F.lit("p?")).alias("pid")))).alias("to"))
    rows = items.join(sender, "id", "left").join(to, "id", "left")
    receivers = F.coalesce(F.array_join(F.transform("to", lambda x: x["pid"]), ","), F.lit("-"))
    line = F.concat(T.message_time("timestamp", "timestamp_raw"), F.lit(" "), F.coalesce("sender", F.lit("p?")), F.lit(" -> "), receivers, F.lit(": "), F.left(T.collapse("body"), F.lit(1200)))
    return rows.select("id", "conversation_id", "timestamp", "pos", line.alias("line"))


def _packed(frames: Iterator[pd.DataFrame], budget: int, overlap: int) -> Iterator[pd.DataFrame]:
    """Greedy packing of sorted lines. Only the open chunk is held, whatever the length of a conversation: lines
    that belong to the next chunk as well are carried over."""
    conversation, table, index = None, "", 0
    held: list[tuple[str, str]] = []
    carried = 0

    def cost(n: int, line: str) -> int:
        return len(f"<m{n}> {line}") + 1

    def chunk(rows: list[tuple[str, str]]) -> dict:
        return {
            "chunk_id": f"{conversation}:{index}",
            "conversation_id": conversation,
            "chunk_index": index,
            "participant_table": table,
            "message_lines": [f"<m{n}> {line}" for n, (_, line) in enumerate(rows, 1)],
            "id_map": {f"m{n}": i for n, (i, _) in enumerate(rows, 1)},
        }

    def used(rows: list[tuple[str, str]]) -> int:
        return len(table) + 1 + sum(cost(n, line) for n, (_, line) in enumerate(rows, 1))

    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            if row.conversation_id != conversation:
                if len(held) > carried:
                    out.append(chunk(held))
                conversation, table, index, held, carried = row.conversation_id, row.participant_table or "", 0, [], 0
            # a chunk that is full is closed; what it shares with the next may be too much for that one as well
            while held and used(held) + cost(len(held) + 1, row.line) > budget:
                if len(held) > carried:
                    out.append(chunk(held))
                    index += 1
                    held = held[max(1, len(held) - overlap) :]
                else:
                    # the carried lines are a chunk of their own, as the next line doesn't fit behind them
                    out.append(chunk(held))
                    index += 1
                    held = held[max(1, len(held) - overlap) :]
                carried = len(held)
            held.append((row.id, row.line))
        yield pd.DataFrame(out, columns=["chunk_id", "conversation_id", "chunk_index", "participant_table", "message_lines", "id_map"])
    if len(held) > carried:
        yield pd.DataFrame([chunk(held)])


def pack(lines: DataFrame, tables: DataFrame, budget: int = BUDGET, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of each conversation's lines in time order, nulls last. A conversation streams through one task,
    as packing is sequential; memory is one chunk."""
    rows = lines.join(tables, "conversation_id", "left").select("conversation_id", "participant_table", "id", "line", F.col("timestamp").isNull().alias("unknown"), "timestamp", "pos")
    in_order = rows.repartition("conversation_id").sortWithinPartitions("conversation_id", "unknown", "timestamp", "pos").select("conversation_id", "participant_table", "id", "line")
    return in_order.mapInPandas(lambda it: _packed(it, budget, overlap), CHUNKS)


def chunk_items(items: DataFrame, least: int = 5, budget: int = BUDGET, overlap: int = OVERLAP) -> DataFrame:
    """All chunks of the given (canonical) items."""
    items = with_conversation(items)
    clean = without_boilerplate(items, boilerplate(items, least)) if least > 0 else items
    named = participants(clean)
    return pack(message_lines(clean, named), participant_tables(named), budget, overlap)


def full_text(chunks: DataFrame) -> DataFrame:
    """A chunk as it is sent, and its estimated tokens."""
    text = F.concat("participant_table", F.lit("\n"), F.array_join("message_lines", "\n"))
    return chunks.withColumn("full_text", text).withColumn("tokens", T.token_estimate("full_text"))


def cache_key(model: str, version: str, text: str = "full_text"):
    """The key under which an answer is kept."""
    return F.left(F.sha2(F.concat(F.lit(model + version), F.col(text)), 256), F.lit(20))


def dry_run(chunks: DataFrame, cache: DataFrame, model: str, version: str, output_tokens: int = 800, input_price: float = 0.8, output_price: float = 4.0) -> DataFrame:
    """Chunks, cached ones, tokens and the cost of the rest, prices per million tokens."""
    keyed = full_text(chunks).withColumn("key", cache_key(model, version))
    known = keyed.join(cache.select("key", F.lit(True).alias("hit")), "key", "left")
    new = F.col("hit").isNull()
    sums = known.agg(
        F.count("*").alias("chunks"), F.count_if(~new).alias("cache_hits"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(new, F.col("tokens"))), F.lit(0)).alias("uncached_tokens"), (F.count_if(new) * output_tokens).alias("output_tokens"),
    )
    return sums.withColumn("cost", F.col("uncached_tokens") * input_price / 1e6 + F.col("output_tokens") * output_price / 1e6)
