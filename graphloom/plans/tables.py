"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import entities as E
from graphloom.operators.entities import Found
from graphloom.schema import PARTICIPANT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def participant(role, name, id_type="none", value=None, kind="person", raw=None):
    """A participant struct from columns or texts."""
    of = lambda x: x if not (x is None or isinstance(x, str)) else F.lit(x).cast("string")
    value = of(value)
    raw = value if raw is None else of(raw)
    parts = [of(name), of(id_type), value, raw, of(role), of(kind)]
    names = ["display_name", "id_type", "id_value", "raw", "role", "kind"]
    return F.struct(*[p.alias(n) for p, n in zip(parts, names, strict=True)], F.array().cast("array<string>").alias("descriptors")).cast(PARTICIPANT)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items without participants; languages stand for source types, as sources separate the copies."""
    docs = table(spark, sf_dir, "documents")
    none = F.array().cast(f"array<{PARTICIPANT}>")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.col("lang").alias("source_type"), F.col("source").alias("conversation_id"), F.lit(None).cast("string").alias("subject"), F.col("text").alias("body"),
        none.alias("participants"), T.content_hash(F.lit(""), F.lit(""), "text").alias("content_hash"), F.lit(None).cast("long").alias("duplicate_of"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items, each sent by its user; the kind of event stands for channel and conversation."""
    e = table(spark, sf_dir, "events")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("pos"), F.col("event_type").alias("source_type"), F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")).alias("conversation_id"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.lit("").alias("timestamp_raw"), F.col("event_type").alias("subject"), F.col("props").alias("body"),
        F.array(
            participant("sender", F.concat(F.lit("User "), F.col("user_id").cast("string")), "email", F.concat(user, F.lit("@example.com"))),
            participant("recipient", F.lit(None).cast("string"), "email", F.concat(F.lit("team"), (F.col("event_id") % 5).cast("string"), F.lit("@example.org"))),
        ).alias("participants"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, role, person_id): each order is sent by its customer to the suppliers of its lines."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    item = F.col("o_orderkey").cast("string").alias("item_id")
    senders = o.select(item, F.lit("sender").alias("role"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("person_id"))
    receivers = line.select(F.col("l_orderkey").cast("string").alias("item_id"), F.lit("recipient").alias("role"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("person_id"))
    return senders.unionAll(receivers)


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items: a price in the text, half of them with a currency word."""
    o = table(spark, sf_dir, "orders")
    price = F.format_number("o_totalprice", 2)
    sign = F.element_at(F.array(F.lit(""), F.lit(" eur"), F.lit(""), F.lit(" usd")), (F.col("o_custkey") % 4 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("source_type"), F.lit("").alias("subject"),
        F.concat(F.lit("Order paid: $"), price, F.lit(". Booked as "), price, sign).alias("body"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )


def parties(spark: SparkSession, sf_dir: str) -> Found:
    """Customers and suppliers as persons, mentioned by the orders that they take part in."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    mail = lambda name: F.array(F.concat(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), F.lit("@example.com")))
    people = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("label"), mail("c_name").alias("emails")).unionAll(
        s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), (F.col("s_suppkey") + 10_000_000).alias("pos"), F.col("s_name").alias("label"), mail("s_name").alias("emails"))
    )
    told = orders(spark, sf_dir).select(F.col("person_id").alias("entity_id"), "item_id").distinct()
    return Found(E.shaped(people.withColumn("aliases", F.array("label")), "person"), told.select("entity_id", "item_id", F.col("entity_id").alias("text"), F.col("item_id").cast("long").alias("pos")))


def typed_mentions(spark: SparkSession, sf_dir: str) -> Found:
    """Entities of four kinds with orders as their items: amounts by order priority and status, organisations by
    supplier, locations by the customer's nation, documents by part, subevents by the state of a line."""
    o, line, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    item = lambda col: F.col(col).cast("string").alias("item_id")
    money = o.select(F.concat_ws("|", F.lit("m"), "o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 9).cast("string")).alias("entity_id"), item("o_orderkey"), F.lit("money").alias("type"))
    org = line.select(F.concat(F.lit("o"), (F.col("l_suppkey") % 40).cast("string")).alias("entity_id"), item("l_orderkey"), F.lit("org").alias("type"))
    place = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("l"), F.col("c_nationkey").cast("string")).alias("entity_id"), item("o_orderkey"), F.lit("location").alias("type"))
    doc = line.select(F.concat(F.lit("d"), (F.col("l_partkey") % 150).cast("string")).alias("entity_id"), item("l_orderkey"), F.lit("document").alias("type"))
    sub = line.select(F.concat_ws("|", F.lit("v"), "l_returnflag", "l_linestatus").alias("entity_id"), item("l_orderkey"), F.lit("subevent").alias("type"))
    told = money.unionAll(org).unionAll(place).unionAll(doc).unionAll(sub).distinct()
    rows = told.groupBy("entity_id", "type").agg(F.count("*").alias("n")).select(F.col("entity_id").alias("id"), F.lit(0).cast("long").alias("pos"), F.col("entity_id").alias("label"), "type")
    return Found(rows, told.select("entity_id", "item_id"))
