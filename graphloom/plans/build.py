"""From items to a knowledge graph: the stages wired together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import chunks, contract, dedup, entities, extraction, graph, identity, merge, profiles, relations
from graphloom.operators.entities import Found
from graphloom.operators.order import ranked
from graphloom.scratch import materialise
from graphloom.sources import store


@dataclass
class Bundle:
    """The result of a build: its tables, and the figures about it."""

    items: DataFrame
    canonical: DataFrame
    entities: DataFrame
    mentions: DataFrame
    edges: DataFrame
    merges: DataFrame
    members: DataFrame
    relevance: DataFrame
    timeline: DataFrame
    review: DataFrame
    repairs: DataFrame
    stats: dict = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in self.__dict__.items() if isinstance(v, DataFrame)}

    def graph(self) -> contract.Graph:
        return contract.Graph(self.items, self.entities, self.mentions, self.edges, self.merges)

    def save(self, path: str) -> str:
        return store.save(self.items.sparkSession, self.tables(), path, self.stats)

    @classmethod
    def load(cls, spark, *paths: str) -> Bundle | None:
        found = store.load(spark, *paths)
        return cls(**found[0], stats=found[1]) if found else None


@dataclass
class Verified:
    """Verified claims of a client: messages, mentions and relations, and a resolver of profile blocks, which maps
    (block, payload) rows to proposed clusters (block, k, member_ids, canonical_name, confidence, evidence)."""

    messages: DataFrame
    mentions: DataFrame
    relations: DataFrame
    resolve: Callable[[DataFrame], DataFrame]


REVIEW = "member_ids array<string>, canonical_name string, confidence string, evidence string, type string"


def prepare(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items with shared mailboxes and duplicates marked, the canonical map, and the near clusters."""
    marked = materialise(identity.mark_shared_mailboxes(items), "items")
    near = materialise(dedup.near_clusters(marked), "near")
    exact = dedup.exact_canonical(marked).withColumnRenamed("canonical_id", "exact_id")
    both = exact.join(near.where("id <> canonical_id"), "id", "full").select("id", F.coalesce("exact_id", "canonical_id").alias("canonical_id"))
    canon = materialise(both, "canonical")
    return materialise(dedup.mark_duplicates(marked, canon), "marked"), canon, near


def resolved_claims(claims: Verified, items: DataFrame, people: Found) -> tuple[Found, Found, DataFrame, DataFrame, DataFrame, DataFrame]:
    """People merged by their profiles, organisations and locations from profiles, (conversation_id, local_entity,
    entity_id), merges, and clusters for review."""
    chunk = F.substring_index("chunk_id", ":", -1).cast("long")
    told = materialise(ranked(claims.mentions.withColumn("__chunk", chunk), ["conversation_id", "__chunk", "k"], "pos").drop("__chunk"), "told")
    held = materialise(profiles.from_mentions(told, items), "profiles")
    members = materialise(profiles.blocks(held), "blocks").select("block", "id")
    prompts = extraction.block_prompts(profiles.serialised(held), members, "", "")
    valid = profiles.valid_clusters(claims.resolve(prompts), members, held)
    accepted, review = profiles.settle(valid, members, held)
    accepted = materialise(accepted, "accepted")
    groups, merges = profiles.roll_up(accepted, held)
    groups = materialise(groups, "groups")
    person = profiles.person_of(held, people.entities)
    remap = materialise(profiles.merged_people(people.entities, people.mentions, person, groups), "people")
    merged = _folded(people, remap)
    known = merge.renamed(person.select("profile_id", "entity_id"), "entity_id", remap)
    found = merged
    for kind in ("org", "location"):
        of = held.where(F.col("type") == kind)
        made = profiles.entities_of(of, groups).withColumn("id", F.concat(F.lit(f"{kind}:profile:"), "root")).join(of.select(F.col("id").alias("root"), "pos"), "root")
        spoken = made.select(F.col("id").alias("entity_id"), F.explode("item_ids").alias("item_id"), F.col("label").alias("text"), "pos")
        found = found.union(Found(entities.shaped(made, kind), spoken))
        known = known.unionByName(profiles.entity_of(of, groups, kind))
    local = profiles.conversation_profiles(told).join(known, "profile_id").select("conversation_id", "local_entity", "entity_id")
    queue = review.join(held.select(F.col("id").alias("first"), "type"), F.col("member_ids")[0] == F.col("first")).select("member_ids", "canonical_name", "confidence", "evidence", "type")
    named = merges.join(known.select(F.col("profile_id").alias("canonical_id"), "entity_id"), "canonical_id").select(F.col("entity_id").alias("canonical_id"), "merged_forms", "rationale")
    return merged, found, local, named, queue, remap


def _folded(people: Found, remap: DataFrame) -> Found:
    """Persons and mentions with merged persons folded into the ones that stay."""
    to = remap.select(F.col("old_id").alias("id"), "new_id")
    joined = people.entities.join(to, "id", "left").withColumn("target", F.coalesce("new_id", "id"))
    folded = joined.groupBy(F.col("target").alias("__id")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("emails")))).alias("__emails"),
        F.array_distinct(F.concat(F.flatten(F.collect_list("aliases")), F.collect_list("label"))).alias("__names"),
        F.bool_or(F.coalesce("owner", F.lit(False))).alias("__owner"), F.count("*").alias("__n"),
    )
    kept = people.entities.join(remap, people.entities["id"] == remap["old_id"], "left_anti").join(folded, F.col("id") == F.col("__id"))
    many = F.col("__n") > 1
    rows = kept.withColumns(
        {
            "emails": F.when(many, F.col("__emails")).otherwise(F.col("emails")),
            "aliases": F.when(many, F.array_sort(F.array_remove("__names", F.col("label")))).otherwise(F.col("aliases")),
            "owner": F.when(F.col("__owner"), F.lit(True)).otherwise(F.col("owner")),
        }
    ).select(*people.entities.columns)
    return Found(rows, merge.renamed(people.mentions, "entity_id", remap).groupBy("entity_id", "item_id", "text").agg(F.min("pos").alias("pos")))


def build(items: DataFrame, claims: Verified | None = None) -> Bundle:
    """The whole build. Without claims it is structural; with them, profiles merge people, and organisations,
    locations, topics and claimed relations come in. Stage results are written to the shared folder, so that no stage is
    computed twice and none is lost with an executor."""
    spark = items.sparkSession
    marked, canon, near = prepare(items)
    rel = dedup.canonical_items(marked)
    members = materialise(identity.identity_members(rel), "members")
    owner = materialise(identity.owner_pick(identity.owner_scores(identity.identity_clusters(members))), "owner")
    told = materialise(entities.people_mentions(rel, identity.owner_refs(rel, members, owner)), "people-mentions")
    people, merges = entities.people(told, owner)
    people = Found(materialise(people.entities, "people"), materialise(people.mentions, "mentions"))
    topics = extraction.item_topics(claims.messages) if claims else None
    verdicts = materialise(extraction.relevance(rel, topics), "relevance")
    review, claimed = spark.createDataFrame([], REVIEW), None
    found = people
    if claims:
        people, found, local, more, review, _ = resolved_claims(claims, rel, people)
        merges = merges.unionByName(more)
        claimed = relations.claimed(claims.relations.select("conversation_id", "subject", "object", "type", "item_id"), local)
    orgs, org_members = entities.domain_orgs(people)
    amounts = entities.amount_items(rel)
    found = found.union(orgs).union(entities.money(materialise(amounts, "amounts"))).union(entities.subevents(rel)).union(entities.documents(rel))
    found = Found(materialise(found.entities, "entities"), materialise(found.mentions, "all-mentions"))
    edges = relations.structural(rel, found.entities, found.mentions, org_members)
    if claimed is not None:
        edges = edges.unionByName(claimed)
    edges = materialise(edges, "edges")

    merged, moved, by_name = merge.merge_by_name(found)
    merged = Found(materialise(merged.entities, "merged"), materialise(merged.mentions, "merged-mentions"))
    moved = materialise(moved, "moved")
    ids = materialise(merge.stable_ids(merged.entities, merged.mentions), "ids")
    remap = merge.chained(moved, ids)
    final = contract.Graph(
        marked, merge.renamed(merged.entities, "id", ids), merge.renamed(merged.mentions, "entity_id", ids), relations.numbered(relations.remapped(edges, remap)),
        merge.renamed(merges.unionByName(by_name), "canonical_id", remap),
    )
    final = contract.Graph(marked, *[materialise(t, "final") for t in (final.entities, final.mentions, final.edges, final.merges)])
    repaired, actions = contract.repair(final)
    tables = [materialise(t, "repaired") for t in (repaired.entities, repaired.mentions, repaired.edges, repaired.merges)]
    who = merge.renamed(merge.renamed(org_members, "entity_id", remap), "person_id", remap)
    timeline = graph.subevent_timeline(tables[0], tables[1], marked)
    bundle = Bundle(marked, canon, *tables, who, verdicts, materialise(timeline, "timeline"), review, materialise(actions, "actions"))
    bundle.stats = stats(bundle, near, owner, "llm" if claims else "heuristic")
    return bundle


def stats(b: Bundle, near: DataFrame, owner: DataFrame, mode: str) -> dict:
    """Figures about a build, people counted after repair."""
    copies = dedup.copy_counts(b.items, near, b.canonical).first()
    n = b.items.agg(F.count("*").alias("items"), F.count_if(F.col("duplicate_of").isNull()).alias("canonical_items")).first()
    kinds = {r.type: r["count"] for r in b.entities.groupBy("type").count().collect()}
    top = owner.first()
    return {
        "items": n["items"], "canonical_items": n["canonical_items"], "relevant_items": b.relevance.where("relevant").count(), "exact_dupes": copies.exact_dupes, "near_dupes": copies.near_dupes,
        "n_duplicates": copies.n_duplicates, "entities": sum(kinds.values()), "edges": b.edges.count(), "people": kinds.get("person", 0), "merges": b.merges.count(), "mode": mode,
        "owner": top.label if top else None, "owner_confident": bool(top and top.confident), "review_queue": b.review.count(), "contract_repairs": b.repairs.count(),
    }


def verified(chunk_rows: DataFrame, answers: DataFrame, resolve: Callable[[DataFrame], DataFrame]) -> Verified:
    """Claims from answers (chunk_id, answer), verified against the chunks."""
    messages, mentions, rels, _ = extraction.verify(chunk_rows, extraction.parsed(answers))
    return Verified(materialise(messages, "messages"), materialise(mentions, "claimed-mentions"), materialise(rels, "claimed-relations"), resolve)


def no_clusters(prompts: DataFrame) -> DataFrame:
    """A resolver that proposes nothing: every profile stays as it is."""
    return prompts.sparkSession.createDataFrame([], "block string, k int, member_ids array<string>, canonical_name string, confidence string, evidence string")


def chunked(b_items: DataFrame) -> DataFrame:
    """The chunks of the canonical items."""
    return chunks.chunk_items(dedup.canonical_items(b_items))
