"""What a bundle answers: preset questions, listings, details, reports. Each view is a DataFrame or a small dict of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import currency as C
from graphloom.functions import text as T
from graphloom.operators import graph as G
from graphloom.operators.entities import first_few
from graphloom.operators.relations import degree
from graphloom.plans.build import Bundle

# The preset questions; so are the words of the answers below.
QUESTIONS = [("money", "What are the financial amounts and costs?"), ("timeline", "Show the timeline of events in order."), ("who", "Who are the key people involved?")]


def citations(b: Bundle, ids: DataFrame, k: int = 8) -> DataFrame:
    """(item_id, source_type, snippet) of the first k of ids(item_id, rank)."""
    first = ids.orderBy("rank", "item_id").limit(k)
    return b.items.select(F.col("id").alias("item_id"), "source_type", T.snippet("subject", "body").alias("snippet")).join(F.broadcast(first), "item_id").orderBy("rank", "item_id").drop("rank")


def _cited(b: Bundle, rows: DataFrame) -> DataFrame:
    return citations(b, rows.select(F.explode("item_ids").alias("item_id")).groupBy("item_id").agg(F.lit(0).alias("rank")))


def money(b: Bundle) -> dict:
    """F35, E33."""
    rows = G.money_rows(b.entities, b.mentions, b.edges)
    totals = G.money_totals(b.entities).orderBy("currency")
    n = rows.agg(F.count_if(~F.col("flagged")).alias("known"), F.count_if("flagged").alias("unknown")).first()
    shown = ", ".join(f"{r.total:,.2f} {r.currency}" for r in totals.collect())
    answer = "No financial amounts found."
    if n.known + n.unknown:
        answer = f"{n.known} amount(s) resolved"
        answer += f"; {n.unknown} flagged (no currency marker — excluded from totals)" if n.unknown else ""
        answer += f". Total: {shown}" if shown else ""
    caveats = ["Amounts with no currency marker are flagged and excluded from totals."] if n.unknown else []
    return {"answer": answer, "table": rows, "totals": totals, "caveats": caveats, "citations": _cited(b, rows), "subgraph": rows.select("entity_id")}


def timeline(b: Bundle) -> dict:
    """F35, E33."""
    found = G.episodes(b.items, b.relevance, b.timeline)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    through = F.when(day("start") != day("end"), F.concat(F.lit(" through "), day("end"))).otherwise("")
    steps = found.select("start", F.concat("label", F.lit(" — "), F.col("count").cast("string"), F.lit(" item(s)"), through).alias("text"), "source", "item_ids").orderBy("start", "text")
    n = steps.count()
    return {"answer": f"Timeline: {n} episode(s) in order." if n else "No timeline events found.", "steps": steps, "citations": _cited(b, found)}


def who(b: Bundle) -> dict:
    """F35, E33."""
    rows = G.who_rows(b.items, b.entities, b.mentions, b.edges)
    n = rows.count()
    return {"answer": f"{n} key people identified (owner excluded)." if n else "No people found.", "table": rows, "citations": _cited(b, rows), "subgraph": rows.select("entity_id")}


PRESETS: dict[str, Callable[[Bundle], dict]] = {"money": money, "timeline": timeline, "who": who, "correspondents": who}


def run(name: str, b: Bundle) -> dict:
    """E33; an unknown name is a KeyError."""
    return PRESETS[name](b)


def starter_questions(b: Bundle) -> DataFrame:
    """The presets and a question about each of the two most mentioned people."""
    spark = b.items.sparkSession
    count = b.mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    people = b.entities.where("type = 'person' and not coalesce(owner, false)").join(count, "id").orderBy(F.desc("n"), "pos", "id").limit(2)
    asked = people.select(F.lit("who").alias("id"), F.concat(F.lit("What do we know about "), "label", F.lit("?")).alias("q"), F.col("id").alias("entity_id"))
    return spark.createDataFrame([(i, q, None) for i, q in QUESTIONS], "id string, q string, entity_id string").unionByName(asked)


def verdicts(b: Bundle) -> DataFrame:
    """(item_id, relevant, rationale); a duplicate has its canonical item's verdict, one hop."""
    own = b.relevance.select("item_id", "relevant", "rationale")
    inherited = b.items.where("duplicate_of is not null").select(F.col("id").alias("copy"), F.col("duplicate_of").alias("item_id")).join(own, "item_id")
    rest = inherited.join(own.select(F.col("item_id").alias("copy")), "copy", "left_anti").select(F.col("copy").alias("item_id"), "relevant", "rationale")
    return own.unionByName(rest)


def items_page(b: Bundle, source_type: str | None = None, relevant: bool | None = None, conversation: str | None = None, q: str | None = None, limit: int = 100, offset: int = 0) -> tuple[DataFrame, int]:
    """A page of the items that fit, in input order, and how many fit."""
    rows = b.items
    if source_type:
        rows = rows.where(F.col("source_type") == source_type)
    if conversation:
        rows = rows.where(F.col("conversation_id") == conversation)
    if q:
        rows = rows.where(F.lower("body").contains(q.lower()) | F.lower(F.coalesce("subject", F.lit(""))).contains(q.lower()))
    judged = rows.join(verdicts(b).withColumnRenamed("item_id", "id"), "id", "left")
    if relevant is not None:
        judged = judged.where(F.col("relevant") == relevant)
    page = judged.orderBy("pos").offset(offset).limit(min(limit, 500))
    return page.select(
        "id", "source_type", "channel", "conversation_id", "timestamp", T.sender_display().alias("sender"), "subject", F.left("body", F.lit(140)).alias("preview"), "duplicate_of",
        "relevant", F.coalesce("rationale", F.lit("not scored")).alias("relevance_rationale"),
    ), judged.count()


def item(b: Bundle, item_id: str) -> tuple[DataFrame, DataFrame]:
    """An item with its verdict, and the entities that it mentions."""
    row = b.items.where(F.col("id") == item_id).join(b.relevance.withColumnRenamed("item_id", "id"), "id", "left")
    told = b.mentions.where(F.col("item_id") == item_id).select(F.col("entity_id").alias("id")).distinct()
    return row.withColumns({"sender": T.sender_display(), "recipients": T.recipients_display()}), b.entities.join(told, "id", "left_semi").select("id", "label", "type")


def entity(b: Bundle, entity_id: str) -> tuple[DataFrame, DataFrame]:
    """An entity, and its first 50 mentions with what stands there."""
    first = b.mentions.where(F.col("entity_id") == entity_id).orderBy("pos", "item_id", "text").limit(50)
    source = b.items.select(F.col("id").alias("item_id"), "source_type", F.left("body", F.lit(160)).alias("snippet"))
    return b.entities.where(F.col("id") == entity_id), first.join(source, "item_id", "left").select("item_id", "text", F.coalesce("source_type", F.lit("")).alias("source_type"), F.coalesce("snippet", F.lit("")).alias("snippet"))


def entity_answer(b: Bundle, entity_id: str) -> dict:
    """An entity with 20 of its edges, 8 citations, and itself with 10 neighbours; or an error."""
    found = b.entities.where(F.col("id") == entity_id)
    top = found.first()
    if top is None:
        return {"error": f"entity {entity_id!r} not found", "answer": ""}
    tied = b.edges.where((F.col("source") == entity_id) | (F.col("target") == entity_id)).orderBy("id")
    other = F.when(F.col("source") == entity_id, F.col("target")).otherwise(F.col("source"))
    ids = b.mentions.where(F.col("entity_id") == entity_id).groupBy("item_id").agg(F.min("pos").alias("rank"))
    return {"answer": f"Entity: {top.label} ({top.type})", "entity": found, "edges": tied.limit(20), "citations": citations(b, ids), "subgraph": tied.limit(10).select(other.alias("entity_id"))}


def merge_list(b: Bundle) -> DataFrame:
    """P15."""
    return b.merges.where(F.size("merged_forms") > 1)


def graph_view(b: Bundle, min_degree: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes, persons only from a degree on, and the links between them."""
    count = b.mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("mentions"))
    nodes = b.entities.join(degree(b.edges), "id", "left").join(count, "id", "left").fillna(0, ["degree", "mentions"]).where((F.col("degree") >= min_degree) | (F.col("type") != "person"))
    nodes = nodes.select("id", "label", "type", "mentions", "degree", "emails", "currency", F.coalesce("needs_review", F.lit(False)).alias("needs_review"))
    keep = nodes.select(F.col("id").alias("__k"))
    links = b.edges.join(keep, F.col("source") == F.col("__k"), "left_semi").join(keep, F.col("target") == F.col("__k"), "left_semi")
    return nodes, links.select("source", "target", "kind", "weight")


def node_list(b: Bundle, search: str = "") -> DataFrame:
    """Nodes whose label holds the text, by degree."""
    return graph_view(b, 0)[0].where(F.lower("label").contains(search.lower())).orderBy(F.desc("degree"), "id")


def currency_flags(b: Bundle) -> DataFrame:
    """Amounts for review with why and where, largest first."""
    flagged = b.entities.where("type = 'money' and needs_review")
    told = b.mentions.join(flagged.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    first = first_few(told, ["entity_id"], "item_id", 4, "pos").select("entity_id", F.posexplode("item_id").alias("k", "item_id"))
    source = first.join(b.items.select(F.col("id").alias("item_id"), "source_type", F.trim(F.left("body", F.lit(140))).alias("snippet")), "item_id")
    listed = source.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("k", "item_id", "source_type", "snippet"))).alias("sources"))
    reason = F.when(F.col("currency_ambiguous"), "mixed-currency").otherwise("no-currency-marker")
    return flagged.withColumnRenamed("id", "entity_id").join(listed, "entity_id", "left").select("entity_id", "amount", reason.alias("reason"), F.col("currency_evidence").alias("evidence"), "sources").orderBy(F.desc("amount"))


def known_currencies() -> list[str]:
    return list(C.SYMBOL_OF)


def ask(b: Bundle, question: str, client=None, system: str = "", k_items: int = 16) -> dict:
    """The context of a question, and with a client its answer and citations."""
    index = G.surface_tokens(b.entities)
    seeds, matched = G.ask_seeds(b.entities, index, question)
    reached, edge_ids = G.neighbourhood(b.edges, seeds)
    near = G.neighbourhood_items(reached, edge_ids, b.edges, b.mentions)
    top = G.evidence(b.items, near, question, k_items)
    text = G.context_text(b.entities, b.edges, seeds, matched, reached, edge_ids)
    when = F.coalesce(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm"), F.lit("n/a"))
    line = F.concat(F.lit("["), "id", F.lit("] ("), "source_type", F.lit(", "), when, F.lit(") from "), F.left(T.sender_display(), F.lit(50)), F.lit(": "), F.left(T.collapse("body"), F.lit(450)))
    lines = top.select("id", line.alias("line")).collect()
    out = {"question": question, "subgraph_text": text, "retrieved": [r.id for r in lines]}
    if client:
        block = "\n\n".join(r.line for r in lines)
        out["answer"] = client.complete(system, f"QUESTION: {question}\n\nGRAPH CONTEXT (relevant subgraph):\n{text}\n\nSOURCE ITEMS (cite these ids):\n{block}")
        answers = b.items.sparkSession.createDataFrame([(question, out["answer"])], "question string, answer string")
        out["citations"] = [r.item_id for r in G.cited(answers, b.items).orderBy("rank").collect()]
    return out


def report(b: Bundle) -> dict:
    """The graph in figures."""
    spoken = b.mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    persons = b.entities.where("type = 'person'").join(spoken, "id", "left").fillna(0, ["n"])
    owner = persons.orderBy(F.desc(F.coalesce("owner", F.lit(False))), F.desc("n"), "pos", "id").first()
    top = persons.where(F.col("id") != (owner.id if owner else "")).orderBy(F.desc("n"), "pos", "id").limit(10).select("label", F.col("n").alias("mentions"))
    repeated = b.entities.where("type in ('org', 'location')").groupBy("type", T.report_key("label").alias("key")).agg(F.array_sort(F.collect_set("label")).alias("labels")).where(F.size("labels") > 1)
    total = b.entities.count()
    isolated = b.entities.join(degree(b.edges), "id", "left_anti").count()
    return {
        "entity_counts": b.entities.groupBy("type").count(), "persons_unknown": persons.where(F.lower(F.trim("label")).isin("", "unknown")).count(),
        "owner": {"label": owner.label if owner else None, "mentions": owner.n if owner else 0, "inferred": not (owner and owner.owner)}, "top_correspondents": top,
        "label_groups": repeated, "isolated": isolated, "isolated_pct": round(100 * isolated / total, 1) if total else 0.0,
        "unique_after_dedup": b.items.select(F.coalesce("duplicate_of", "id")).distinct().count(),
    }


def ingest_stats(b: Bundle) -> DataFrame:
    """A31."""
    return b.items.groupBy("source_type").agg(
        F.count("*").alias("items"), F.count("timestamp").alias("with_timestamp"), F.count_distinct("conversation_id").alias("conversations"), F.count("duplicate_of").alias("duplicates")
    )


def capabilities() -> dict:
    """P26."""
    return {"queries": [{"id": i, "q": q} for i, q in QUESTIONS], "currencies": known_currencies(), "modes": ["heuristic", "llm"]}
