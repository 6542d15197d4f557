"""Claims that a client makes about chunks: asked for once, kept, parsed, and verified against the text."""

from __future__ import annotations

import difflib
import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import INVISIBLE
from graphloom.operators.chunks import cache_key, full_text
from graphloom.operators.components import connected_components
from graphloom.schema import EXTRACTION, MENTION_TYPES, RELATION_TYPES
from graphloom.scratch import materialise


class Client(Protocol):
    """What answers a prompt with JSON text. The library ships no vendor's."""

    def complete(self, system: str, user: str) -> str: ...


class CannedClient:
    """A deterministic offline stand-in: answers by SHA-256 of the user text, or a default."""

    def __init__(self, answers: dict[str, str] | None = None, default: str = "{}") -> None:
        self.answers, self.default, self.calls = answers or {}, default, 0

    @staticmethod
    def key(user: str) -> str:
        return hashlib.sha256(user.encode()).hexdigest()

    def complete(self, system: str, user: str) -> str:
        self.calls += 1
        return self.answers.get(self.key(user), self.default)


class Retrying:
    """A client whose passing errors are tried again after 2**n seconds and a random part of one more; any other error with a
    4xx status is raised at once."""

    def __init__(self, client: Client, tries: int = 3, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> None:
        self.client, self.tries, self.sleep, self.jitter = client, tries, sleep, jitter

    def complete(self, system: str, user: str) -> str:
        for n in range(self.tries):
            try:
                return self.client.complete(system, user)
            except Exception as error:
                status = getattr(error, "status_code", None)
                passing = status is None and isinstance(error, (ConnectionError, TimeoutError)) or status == 429 or (status or 0) >= 500
                if not passing or n + 1 == self.tries:
                    raise
                self.sleep(2.0**n + self.jitter())
        raise AssertionError("unreachable")


def asked(chunks: DataFrame, cache: DataFrame, client: Callable[[], Client], system: str, model: str, version: str, workers: int = 5, tries: int = 2) -> DataFrame:
    """(key, answer, from_cache) of every chunk: kept answers are joined, the rest are asked for, a few calls at
    a time in each task. A call that fails twice gives an empty answer, which is marked by ``failed`` and not kept."""
    keyed = full_text(chunks).withColumn("key", cache_key(model, version)).select("chunk_id", "key", "full_text")
    kept = cache.select("key", "answer")
    known = keyed.join(kept, "key").select("chunk_id", "key", "answer", F.lit(True).alias("from_cache"), F.lit(False).alias("failed"))

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = client()

        def one(text: str) -> tuple[str, bool]:
            for _ in range(tries):
                try:
                    return mine.complete(system, text), False
                except Exception:  # noqa: BLE001  any failure counts as one try
                    continue
            return "{}", True

        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                answers = list(pool.map(one, frame.full_text))
                yield pd.DataFrame({"chunk_id": frame.chunk_id, "key": frame.key, "answer": [a for a, _ in answers], "from_cache": False, "failed": [f for _, f in answers]})

    new = keyed.join(kept.select("key"), "key", "left_anti").select("chunk_id", "key", "full_text")
    return known.unionByName(new.mapInPandas(call, "chunk_id string, key string, answer string, from_cache boolean, failed boolean"))


def cache_of(answers: DataFrame) -> DataFrame:
    """What to keep: answers that did not fail."""
    return answers.where("not failed").select("key", "answer").dropDuplicates(["key"])


def parsed(answers: DataFrame) -> DataFrame:
    """(chunk_id, claim): the JSON object in an answer, or nulls if there is none."""
    body = F.regexp_extract("answer", "(?s)\\{.*\\}", 0)
    return answers.select("chunk_id", F.from_json(body, EXTRACTION).alias("claim"))


def _visible(c):
    return F.regexp_replace(F.coalesce(c, F.lit("")), INVISIBLE, "")


def verify(chunks: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The messages, mentions and relations whose message exists, whose type is known, and whose words
    stand in the message as given; and (reason, n) of the others."""
    lines = chunks.select("chunk_id", "conversation_id", F.explode(F.map_entries("id_map")).alias("e"), "message_lines")
    line = F.get("message_lines", F.regexp_extract("e.key", "\\d+", 0).cast("int") - 1)
    texts = lines.select("chunk_id", "conversation_id", F.col("e.key").alias("message_id"), F.col("e.value").alias("item_id"), _visible(line).alias("line"))

    def against(rows: DataFrame, reasons) -> DataFrame:
        found = rows.join(texts.drop("conversation_id"), ["chunk_id", "message_id"], "left")
        return found.join(chunks.select("chunk_id", "conversation_id"), "chunk_id").withColumn("reason", reasons)

    missing = F.col("line").isNull()
    said = lambda c: (_visible(F.col(c)) != "") & F.col("line").contains(_visible(F.col(c)))
    opened = lambda part: claims.select("chunk_id", F.posexplode(f"claim.{part}").alias("k", "x"))
    messages = against(opened("messages").select("chunk_id", "k", F.col("x.id").alias("message_id"), "x.topics", F.col("x.reason").alias("why")), F.when(missing, "bad_message_id"))
    mentions = against(
        opened("mentions").select("chunk_id", "k", "x.message_id", "x.surface", "x.type", "x.participant_id", "x.local_entity", "x.clues"),
        F.when(missing, "bad_message_id").when(~F.coalesce(F.col("type").isin(*MENTION_TYPES), F.lit(False)), "bad_mention_type").when(~said("surface"), "surface_not_found"),
    )
    relations = against(
        opened("relations").select("chunk_id", "k", "x.message_id", "x.type", F.col("x.subject_local_entity").alias("subject"), F.col("x.object_local_entity").alias("object"), "x.evidence_span"),
        F.when(~F.coalesce(F.col("type").isin(*RELATION_TYPES), F.lit(False)), "bad_relation_type").when(missing, "bad_message_id").when(~said("evidence_span"), "evidence_not_found"),
    )
    rejected = messages.select("reason").unionByName(mentions.select("reason")).unionByName(relations.select("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    good = lambda rows: rows.where("reason is null").drop("reason", "line")
    return good(messages), good(mentions), good(relations), rejected


def topic_key(label: str = "topic"):
    """A label as consolidation compares it."""
    return F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9 ]", "")


def alike_topics(labels: DataFrame, least: float = 0.85) -> DataFrame:
    """(a, b), a < b, of distinct labels (topic) whose keys have a matching ratio of ``least`` or more.

    Pairs come from shared pieces of the keys, which loses none at 0.85: of M matched characters in blocks, neighbouring blocks have an
    unmatched character between them, and those are at most 0.353 M; so a match of two or more has a block of two, one of seven or
    more a block of three. Keys of ten or fewer characters share a pair, longer ones three characters. A frequent piece is a
    skewed key of the join, which is split."""
    if least < 0.85:
        raise ValueError("pairs from shared pieces are complete from 0.85 on")
    keyed = labels.select("topic", topic_key().alias("key")).withColumn("n", F.length("key"))
    pieces = lambda size, few: F.when(few, F.transform(F.sequence(F.lit(1), F.col("n") - (size - 1)), lambda k: F.substr("key", k, F.lit(size))))
    none = F.array().cast("array<string>")
    held = F.array_distinct(
        F.concat(F.coalesce(pieces(2, (F.col("n") >= 2) & (F.col("n") <= 10)), none), F.coalesce(pieces(3, F.col("n") >= 9), none), F.when(F.col("n") < 2, F.array(F.concat(F.lit("="), "key"))).otherwise(none))
    )
    long = keyed.select("topic", "key", "n", F.explode(held).alias("piece"))
    other = long.select(F.col("topic").alias("b"), F.col("key").alias("key_b"), F.col("n").alias("n_b"), "piece")
    # a ratio of 0.85 needs lengths within 0.85 to 1.15 of their mean
    near = long.join(other, "piece").where((F.col("topic") < F.col("b")) & (2 * F.least("n", "n_b") >= least * (F.col("n") + F.col("n_b"))))
    pairs = near.select(F.col("topic").alias("a"), "b", "key", "key_b").distinct()

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, later, first).ratio() for first, later in zip(x, y, strict=True)])

    return pairs.where(ratio("key", "key_b") >= least).select("a", "b")


def consolidated_topics(labels: DataFrame, least: float = 0.85) -> DataFrame:
    """(topic, head) of distinct labels: a label's head is the first head, in order, that is alike, else itself. The order matters only
    among labels that are linked, so each component of the links is decided apart."""
    distinct = materialise(labels.select("topic").distinct(), "topics")
    links = materialise(alike_topics(distinct, least), "topic-links")
    parts = connected_components(links, "a", "b")
    within = links.join(parts, F.col("a") == F.col("node")).select("component", "a", "b")

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        earlier: dict[str, list[str]] = {}
        for a, b in zip(frame.a, frame.b, strict=True):
            earlier.setdefault(b, []).append(a)
            earlier.setdefault(a, [])
        head: dict[str, str] = {}
        for label in sorted(earlier):
            head[label] = min((a for a in earlier[label] if head[a] == a), default=label)
        return pd.DataFrame({"topic": list(head), "head": list(head.values())})

    decided = within.groupBy("component").applyInPandas(decide, "topic string, head string")
    return distinct.join(decided, "topic", "left").select("topic", F.coalesce("head", "topic").alias("head"))


def item_topics(messages: DataFrame) -> DataFrame:
    """(item_id, topics): an item's topics in order, each as its group's label."""
    uses = messages.select("item_id", "chunk_id", "k", F.posexplode("topics").alias("t", "topic"))
    named = uses.join(consolidated_topics(uses), "topic")
    ordered = named.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "k", "t", "head"))).alias("l"))
    return ordered.select("item_id", F.array_distinct(F.transform("l", lambda x: x["head"])).alias("topics"))


def relevance(items: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """A verdict per item; without topics every item counts in full."""
    if topics is None:
        return items.select(F.col("id").alias("item_id"), F.lit(True).alias("relevant"), F.lit(1.0).alias("score"), F.lit("all items included").alias("rationale"), F.array().cast("array<string>").alias("topics"))
    held = items.select(F.col("id").alias("item_id")).join(topics, "item_id", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    some = F.size("topics") > 0
    return held.select(
        "item_id", F.lit(True).alias("relevant"), F.when(some, 1.0).otherwise(0.5).alias("score"), F.when(some, F.array_join(F.slice("topics", 1, 3), ", ")).otherwise("no topics assigned").alias("rationale"), "topics"
    )


def item_extractions(messages: DataFrame, mentions: DataFrame, items: DataFrame) -> DataFrame:
    """Per item whether it has a topic, why, and its mentions."""
    said = messages.groupBy("item_id").agg(F.bool_or(F.size("topics") > 0).alias("relevant"), F.min("why").alias("rationale"))
    named = mentions.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("type", "local_entity", "surface"))).alias("entities"))
    return items.select(F.col("id").alias("item_id")).join(said, "item_id", "left").join(named, "item_id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def block_prompts(profiles_json: DataFrame, members: DataFrame, model: str, version: str) -> DataFrame:
    """(block, key, payload) of the blocks with more than one profile."""
    held = members.join(profiles_json, "id").groupBy("block").agg(F.array_sort(F.collect_list("json")).alias("l")).where(F.size("l") > 1)
    payload = F.concat(F.lit('{"profiles": ['), F.array_join("l", ", "), F.lit("]}"))
    return held.select("block", payload.alias("full_text")).withColumn("key", cache_key(model, version))


def canned_json(value: object) -> str:
    return json.dumps(value, sort_keys=True)
