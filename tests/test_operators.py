import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import currency as C
from graphloom.functions import text as T
from graphloom.functions import times
from graphloom.operators import chunks, contract, dedup, entities, extraction, graph, identity, merge, profiles, relations
from graphloom.operators.components import connected_components
from graphloom.plans import registry
from graphloom.schema import CHUNKS
from graphloom.sources import formats, readers
from graphloom.streaming import limits


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


# ---- functions ----


def test_text_functions(spark):
    rows = ["Re: Fwd: Registration confirmed", "[RESEND] Link", " RE - x", "plain", ""]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(T.normalize_subject("t").alias("s"), F.col("t")).collect()
    assert {r.t: r.s for r in got} == {r: formats.subject_key(r) for r in rows}
    assert one(spark, "‎ Caf é \n X", T.normalize) == "café x" and one(spark, "‎ A b", T.visible) == "Ab"
    assert one(spark, "Smith,  Al B. jo", T.person_key) == "al jo smith" and one(spark, "O'Neil-2 x", T.blocking_key) == "oneil x"
    assert one(spark, "What is the cost of a B2 visa", T.query_tokens) == ["cost", "b2", "visa"]
    assert one(spark, "J.Doe07@x.org", T.email_stem) == "jdoe" and one(spark, "one two", lambda c: T.shingles(T.words(c))) == ["one two"]
    assert one(spark, "", lambda c: T.shingles(T.words(c))) == [] and one(spark, "`Chat: Garden (3 messages)`", T.clean_section) == formats.section_title("`Chat: Garden (3 messages)`")
    assert one(spark, "Excel_rows", T.source_type) == "excel_row" and one(spark, "?", T.source_type) == "other"


def test_money_functions(spark):
    assert one(spark, "1.234,56", C.parsed_amount) == 1234.56 and one(spark, "1,234.56", C.parsed_amount) == 1234.56 and one(spark, "x", C.parsed_amount) is None
    assert one(spark, "CA$ 5", C.currency_of) == "USD" and one(spark, "5000 Rs", C.currency_of) == "INR" and one(spark, "worse", C.currency_of) is None and one(spark, "26 Euros", C.currency_sign) == "euros"
    forms = spark.range(1).select(C.amount_forms(F.lit(1200).cast(C.DECIMAL)).alias("f")).first().f
    assert set(forms) == {"1200.00", "1,200.00", "1200", "1,200"} and [len(f) for f in forms] == sorted(map(len, forms), reverse=True)
    text = "20 eur, not 20340 nor 8,20.5 but 20."
    got = spark.createDataFrame([(text,)], "t string").select(C.windows("t", F.array(F.lit("20"))).alias("w")).first().w
    assert len(got) == 2 and got[0] == "20 eur, not "


def test_time_columns(spark):
    rows = ["[18/03/26, 9:31:24 PM]", "18/03/2026, 22:15", "05/03/26, 9:05 am", "x"]
    got = [r.x for r in spark.createDataFrame([(r,) for r in rows], "t string").select(times.chat_time(F.col("t")).alias("x")).collect()]
    assert got == [times.item_time("whatsapp", r) if r != "x" else None for r in rows]
    mail = "Tue, 03 Mar 2026 10:00:00 -0400"
    assert one(spark, mail, times.mail_time) == times.any_time(mail)
    assert one(spark, "due 19 Feb 2026, paid 05/01/2026, sent 2026-03-01 or March 3, 2026", times.document_date).isoformat() == "2026-01-05T00:00:00"


def test_sources_in_columns(spark):
    lines = ["lost", "[18/03/26, 12:08:48 PM] Jane: hi", "more", "18/03/2026, 22:15 - Bo: late"]
    got = readers.chat_lines(spark.createDataFrame([("f", n, x) for n, x in enumerate(lines)], "file string, n int, line string")).orderBy("message").collect()
    assert [(r.sender, r.body, r.timestamp.hour) for r in got] == [("Jane", "hi\nmore", 12), ("Bo", "late", 22)]
    pages = spark.createDataFrame([("a.pdf", 1, "issued 2026-03-01"), ("a.pdf", 2, " "), ("a.pdf", 3, "due 2026-02-01")], "file string, page int, text string")
    rows = readers.document_pages(pages).orderBy("pos").collect()
    assert [r.id for r in rows] == ["a#p1", "a#p3"] and {r.timestamp.month for r in rows} == {2}
    report = readers.parse_files(spark.createDataFrame([("p.png", b"\x89"), ("n.txt", b"none"), ("ok.csv", b"a,b\n1,2\n")], "name string, content binary"))[1]
    assert {r.name: r.status for r in report.collect()} == {"p.png": "skipped", "n.txt": "partial", "ok.csv": "ok"}
    assert readers.report_totals(report).first().asDict() == {"files": 3, "parsed": 2, "failed": 0, "skipped": 1, "items": 1}


# ---- components, duplicates ----


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 540)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_exact_wins_over_near(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [("a", 0, base), ("b", 1, base + " lambda"), ("c", 2, base + " lambda"), ("d", 3, "ok"), ("e", 4, "ok"), ("f", 5, "short text")]
    items = spark.createDataFrame([(i, p, "email", t, t) for i, p, t in rows], "id string, pos long, source_type string, body string, content_hash string")
    canon = dedup.canonical(items)
    assert {r.id: r.canonical_id for r in canon.collect()} == {"b": "a", "c": "b", "e": "d"}
    assert {r.id: r.root_id for r in dedup.root_of(canon).collect()} == {"b": "a", "c": "a", "e": "d"}
    counts = dedup.copy_counts(items, dedup.near_clusters(items), canon).first()
    assert (counts.exact_dupes, counts.near_dupes, counts.n_duplicates) == (2, 2, 3)


def test_topics_consolidate_like_a_plain_loop(spark):
    rng = random.Random(12)
    labels = {"", "a", "A", "b", "ab", "abc", "-"}
    for _ in range(60):
        word = "".join(rng.choices("abcdef ", k=rng.randrange(2, 24)))
        labels |= {word, word + rng.choice("abc"), word[:-1], word.upper(), word.replace("a", "b", 1)}
    plain = lambda t: re.sub("[^a-z0-9 ]", "", t.strip(" ").lower())
    heads, expected = [], {}
    for x in sorted(labels):
        expected[x] = next((h for h in heads if difflib.SequenceMatcher(None, plain(x), plain(h)).ratio() >= 0.85), x)
        heads += [x] if expected[x] == x else []
    got = extraction.consolidated_topics(spark.createDataFrame([(x,) for x in labels], "topic string")).collect()
    assert {r.topic: r["head"] for r in got} == expected and len(got) == len(labels)


# ---- merging and the contract ----


def person(i, label, emails=(), **more):
    return {"id": i, "pos": int("".join(filter(str.isdigit, i)) or 0), "label": label, "aliases": [label], "emails": list(emails)} | more


def people(spark, rows):
    ddl = "id string, pos long, label string, aliases array<string>, emails array<string>, owner boolean"
    frame = spark.createDataFrame([(r["id"], r["pos"], r["label"], r["aliases"], r["emails"], r.get("owner")) for r in rows], ddl)
    told = spark.createDataFrame([(r["id"], f"i{k}", r["label"], k) for k, r in enumerate(rows) for _ in range(r.get("n", 1))], "entity_id string, item_id string, text string, pos long")
    return entities.Found(entities.shaped(frame, "person"), told)


def test_name_merge(spark):
    found = people(spark, [
        person("p1", "Alice Smith", ["a@x.org"], n=2), person("p2", "Smith Alice"), person("p3", "Bob"), person("p4", "Bob"),
        person("p5", "Cy Roe", ["cy@x.org"]), person("p6", "Cy Roe", ["roe@x.org"]), person("p7", "Di Poe", ["support@x.org"]), person("p8", "Di Poe"),
        person("p9", "Ed Loe", ["ed@x.org"]), person("p10", "Ed Loe", ["ed@x.org", "ed@y.org"], owner=True),
    ])
    merged, remap, records = merge.merge_by_name(found)
    assert {r.old_id: r.new_id for r in remap.collect()} == {"p2": "p1", "p10": "p9"}
    rows = {r.id: r for r in merged.entities.collect()}
    assert rows["p9"].owner and rows["p9"].emails == ["ed@x.org", "ed@y.org"] and rows["p1"].aliases == ["Smith Alice"] and records.count() == 2
    edges = spark.createDataFrame([("p1", "z", "paid", 1.0, ["i1"]), ("p2", "z", "paid", 1.0, ["i2"]), ("p1", "p2", "paid", 1.0, ["i1"])], "source string, target string, kind string, weight double, evidence_item_ids array<string>")
    (e,) = relations.remapped(edges, remap).collect()
    assert (e.source, e.weight, e.evidence_item_ids) == ("p1", 2.0, ["i1", "i2"])


def test_stable_ids_and_currency_decisions(spark):
    found = people(spark, [person("p1", "A B", ["a@x.org"]), person("p2", "C D", ["a@x.org"]), person("p3", "E F")])
    ids = {r.old_id: r.new_id for r in merge.stable_ids(found.entities, found.mentions).collect()}
    assert ids["p2"] == ids["p1"] + "_1" and ids["p3"].startswith("person:") and len(ids["p1"]) == len("person:") + 10
    held = spark.createDataFrame([("i1", 0, "cost 20.00 or $20.00")], "item_id string, pos long, body string").withColumn("amount", F.lit(20).cast(C.DECIMAL))
    money = entities.money(held)
    row = money.entities.first()
    assert row.label == "$20.00" and not row.needs_review and len(row.snippets) == 2
    fixed = merge.corrected_currency(money.entities, spark.createDataFrame([(row.id, "NOK")], "entity_id string, currency string")).first()
    assert (fixed.label, fixed.currency, fixed.needs_review) == ("20.00 kr", "NOK", False)
    mixed = entities.money(held.withColumn("body", F.lit("20.00 eur, then a good deal more text, usd 20.00"))).entities.first()
    assert mixed.currency_ambiguous and mixed.label == "20.00 ⚠ mixed-currency"


def test_whole_contract_leaves_out_no_row(spark):
    sf = "/root/testdata/sf0.01"
    g = registry._broken(spark, sf)
    customers, orders = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "orders"))
    assert g.entities.select("id").distinct().count() == customers.count()
    assert g.items.count() == g.mentions.count() == g.edges.count() == orders.count()
    found = registry.queries()["contract_violations"](spark, sf)
    sources = found.where("rule = 'R6_dangling_source'").count()
    assert sources == orders.where("o_orderpriority like '5%'").count()
    assert found.select("rule").distinct().count() == 11


def test_nulls_breach_the_contract(spark):
    found = people(spark, [person("p1", "A"), person("p2", "B")])
    rows = [("e1", "p1", "p2", None, ["i0"]), ("e2", "p1", None, "paid", ["i0"]), ("e3", "p1", "p2", "paid", None), ("e4", "p2", "p1", "paid", ["i0"])]
    edges = spark.createDataFrame(rows, "id string, source string, target string, kind string, evidence_item_ids array<string>").withColumn("weight", F.lit(1.0))
    bad = found.entities.withColumn("type", F.when(F.col("id") == "p1", F.col("type")))
    items = spark.createDataFrame([("i0",), ("i1",)], "id string")
    none = spark.createDataFrame([], "canonical_id string, merged_forms array<string>, rationale string")
    g = contract.Graph(items, bad, found.mentions, edges, none)
    got = {(r.rule, r.id) for r in contract.violations(g).collect()}
    assert got == {("R2_invalid_type", "p2"), ("R7_invalid_kind", "e1"), ("R6_dangling_target", "e2"), ("R8_no_evidence", "e3")}
    fixed, actions = contract.repair(g)
    assert [r.id for r in fixed.edges.collect()] == ["e4"] and {r.id for r in actions.collect()} == {"e1", "e2", "e3"}


def test_contract_rules_and_repair(spark):
    found = people(spark, [person("p1", "A", owner=True), person("p1", "A"), person("p2", "", owner=True), person("p3", "x" * 130), person("p4", "D")])
    told = found.mentions.where("entity_id <> 'p4'").unionByName(spark.createDataFrame([("p3", "gone", "t", 9)], "entity_id string, item_id string, text string, pos long"))
    odd = entities.shaped(spark.createDataFrame([("m1", "M")], "id string, label string"), "money").withColumn("type", F.lit("money"))
    both = found.entities.unionByName(odd).unionByName(odd.withColumn("id", F.lit("w1")).withColumn("type", F.lit("weird")))
    edges = spark.createDataFrame(
        [("e1", "p1", "p2", "paid", 1.0, ["i0"]), ("e2", "p1", "p2", "paid", 1.0, ["i0"]), ("e3", "p1", "p1", "paid", 1.0, ["i0"]), ("e4", "p1", "zz", "paid", 1.0, ["i0"]), ("e5", "p1", "p3", "likes", 1.0, ["i0"]), ("e6", "p2", "p3", "paid", 1.0, []), ("e7", "p3", "p2", "paid", 1.0, ["gone", "i0"]), ("e8", "zz", "p1", "paid", 1.0, ["i0"])],
        "id string, source string, target string, kind string, weight double, evidence_item_ids array<string>",
    )
    merges = spark.createDataFrame([("p1", ["a"], ""), ("zz", ["b"], "")], "canonical_id string, merged_forms array<string>, rationale string")
    items = spark.createDataFrame([(f"i{k}",) for k in range(5)], "id string")
    g = contract.Graph(items, both, told, edges, merges)
    broken = {(r.rule.split("_")[0], r.id) for r in contract.violations(g).collect()}
    assert broken >= {("R1", "p1"), ("R2", "w1"), ("R3", "p2"), ("R3", "p3"), ("R4", "p4"), ("R4", "p3"), ("R5", "graph"), ("R6", "e4"), ("R6", "e8"), ("R6", "e3"), ("R7", "e5"), ("R8", "e6"), ("R8", "e7"), ("R9", "e2"), ("R10", "zz"), ("R11", "m1")}
    with pytest.raises(contract.ContractError):
        contract.check(g, strict=True)
    fixed, actions = contract.repair(g)
    rows = {r.id: r for r in fixed.entities.collect()}
    assert rows.keys() == {"p1", "p2", "p3"} and rows["p2"].label == "p2" and len(rows["p3"].label) == 120 and rows["p3"].full_label == "x" * 130
    assert {r.id: r.evidence_item_ids for r in fixed.edges.collect()} == {"e1": ["i0"], "e7": ["i0"]} and fixed.merges.count() == 1 and actions.count() > 8
    again, none = contract.repair(fixed)
    assert none.count() == 0 and again.entities.count() == 3


# ---- chunks ----


def packed_plainly(lines, table, budget, overlap):
    out, start = [], 0
    while start < len(lines):
        used, taken = len(table) + 1, []
        for n, line in enumerate(lines[start:], 1):
            text = f"<m{n}> {line}"
            if taken and used + len(text) + 1 > budget:
                break
            taken.append(text)
            used += len(text) + 1
        out.append(taken)
        if start + len(taken) >= len(lines):
            break
        start = max(start + 1, start + len(taken) - overlap)
    return out


def test_packing_matches_a_plain_loop(spark):
    rng = random.Random(9)
    lines = {f"c{c}": ["x" * rng.choice([1, 5, 20, 90, 300]) for _ in range(rng.randrange(1, 40))] for c in range(12)}
    frame = spark.createDataFrame([(f"{c}-{k}", c, None, k, x) for c, xs in lines.items() for k, x in enumerate(xs)], "id string, conversation_id string, timestamp timestamp, pos long, line string")
    tables = spark.createDataFrame([(c, "t" * 10) for c in lines], "conversation_id string, participant_table string")
    for budget in (60, 200, 1000):
        got = chunks.pack(frame, tables, budget, 5)
        assert got.schema == spark.createDataFrame([], CHUNKS).schema
        by = {}
        for r in got.orderBy("chunk_index").collect():
            by.setdefault(r.conversation_id, []).append(r.message_lines)
        assert by == {c: packed_plainly(xs, "t" * 10, budget, 5) for c, xs in lines.items()}


# ---- profiles ----


def profile(i, kind, surfaces, identifiers=(), items=(), channels=("email",)):
    return (i, int("".join(filter(str.isdigit, i))), kind, surfaces, list(identifiers), {}, list(channels), list(items), [], [])


def test_blocks_and_resolution(spark):
    from graphloom.schema import PROFILES

    rows = [
        profile("a1", "person", {"Jane Dorrit": 2}, ["jane.dorrit@x.org"]), profile("a2", "person", {"J": 1}, ["janedorrit@y.org"]), profile("a3", "person", {"Bo Li": 1}),
        profile("o1", "org", {"Acme Dorrit": 1}), profile("l1", "location", {"Springfield": 3}), profile("l2", "location", {"Springfield, USA": 1}), profile("l3", "location", {"Oslo": 1}),
    ] + [profile(f"t{k}", "event", {f"Summer{k} Gathering": 1}, ["same@z.org"] if k < 14 else []) for k in range(20)]
    held = spark.createDataFrame(rows, PROFILES)
    block = {r.id: r.block for r in profiles.blocks(held).collect()}
    assert block["a1"] == block["a2"] != block["a3"] and block["o1"] != block["a1"] and block["l1"] == block["l2"] != block["l3"]
    sizes = {}
    for k in range(20):
        sizes.setdefault(block[f"t{k}"], []).append(k)
    assert sorted(map(len, sizes.values())) == [1] * 8 + [12]
    members = spark.createDataFrame(list(block.items()), "id string, block string").select("block", "id")
    answers = spark.createDataFrame(
        [(block["a1"], 0, ["a1", "a2"], "jane dorrit", "high", "same stem"), (block["l1"], 0, ["l1", "l2"], "Springfield", "low", "contained"), (block["a3"], 0, ["a3", "zz"], "Bo Li", "high", ""), (block["l3"], 0, ["l3", "o1"], "Oslo", "high", "")],
        "block string, k int, member_ids array<string>, canonical_name string, confidence string, evidence string",
    )
    accepted, review = profiles.settle(profiles.valid_clusters(answers, members, held), members, held)
    assert [r.member_ids for r in review.collect()] == [["l1", "l2"]]
    groups, records = profiles.roll_up(accepted, held)
    root = {r.id: r.root for r in groups.collect()}
    assert root["a1"] == root["a2"] and root["l1"] != root["l2"]
    (m,) = records.collect()
    assert m.merged_forms == ["J", "Jane Dorrit"] and m.rationale == "[high] same stem"
    invented = answers.limit(1).withColumn("canonical_name", F.lit("Nobody"))
    assert profiles.valid_clusters(invented, members, held).count() == 0
    rels = spark.createDataFrame([(block["l1"], "l2", "l1", "located_in", ""), (block["l1"], "l2", "zz", "x", "")], "block string, subject_id string, object_id string, type string, evidence string")
    assert profiles.derived_relations(rels, members).count() == 1


# ---- clients and topics ----


class Flaky:
    def __init__(self, *errors):
        self.errors = list(errors)

    def complete(self, system, user):
        if self.errors:
            raise self.errors.pop(0)
        return "{}"


def failure(status):
    e = RuntimeError("no")
    e.status_code = status
    return e


def test_retries():
    waits = []
    assert extraction.Retrying(Flaky(failure(429), failure(503)), sleep=waits.append, jitter=lambda: 0.0).complete("", "") == "{}" and waits == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        extraction.Retrying(Flaky(failure(400)), sleep=waits.append, jitter=lambda: 0.0).complete("", "")
    assert len(waits) == 2


def test_cache(spark):
    chunk = spark.createDataFrame([("c:0", "c", 0, "t", ["<m1> x"], {"m1": "i1"})], CHUNKS)
    empty = spark.createDataFrame([], "key string, answer string")
    ask = lambda cache: extraction.asked(chunk, cache, lambda: extraction.CannedClient(default='{"messages": []}'), "s", "m", "v1")
    first = ask(empty)
    cache = spark.createDataFrame(extraction.cache_of(first).collect(), "key string, answer string")
    assert not first.first().from_cache and ask(cache).first().from_cache and ask(cache).first().answer == first.first().answer
    broken = extraction.asked(chunk, empty, lambda: Flaky(*[failure(400)] * 9), "s", "m", "v1")
    assert broken.first().failed and extraction.cache_of(broken).count() == 0
    assert chunks.dry_run(chunk, cache, "m", "v1").first().asDict()["cache_hits"] == 1


def test_topics(spark):
    labels = spark.createDataFrame([(x,) for x in ("Visa letters", "visa letter", "Hotels", "Visa letters")], "topic string")
    group = {r.topic: r["head"] for r in extraction.consolidated_topics(labels).collect()}
    assert group["visa letter"] == group["Visa letters"] and group["Hotels"] == "Hotels"


# ---- owner, sessions, limits ----


def test_owner_needs_a_lead(spark):
    scores = lambda a, b: spark.createDataFrame([("email:a", {"item_pos": 0, "p_index": 0}, ["Ann Low"], "a", a), ("email:b", {"item_pos": 1, "p_index": 0}, [], "b", b)], "key string, first struct<item_pos: long, p_index: int>, names array<string>, identifier string, score double")
    lead, tie = identity.owner_pick(scores(5.0, 3.0)).first(), identity.owner_pick(scores(3.0, 3.0)).first()
    assert (lead.key, lead.label, lead.confident) == ("email:a", "Ann Low", True) and (tie.key, tie.confident) == ("email:a", False)
    assert identity.owner_pick(scores(1.0, 1.0).limit(0)).first() is None and identity.seed_agrees(identity.owner_pick(scores(5.0, 3.0)), ["A "]).first().seed_agrees


def test_sessions_and_streams(spark, tmp_path):
    rows = [("a", f"2026-01-{d:02d} 00:00:00") for d in (1, 15, 16)] + [("a", "2026-01-31 00:00:00"), ("b", "2026-01-01 00:00:00")]
    times_ = spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("t"))
    got = graph.sessions(times_, ["k"], "t", 15 * 86_400).groupBy("k", "session").count().collect()
    assert sorted((r.k, r["count"]) for r in got) == [("a", 1), ("a", 3), ("b", 1)]
    path = str(tmp_path / "in")
    times_.write.parquet(path)
    stream = spark.readStream.schema(times_.schema).parquet(path)
    q = limits.calls_per_minute(stream, "k", "t").writeStream.outputMode("complete").format("memory").queryName("minutes").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("minutes").groupBy().sum("calls").first()[0] == 5
    kept = limits.kept_sessions(limits.live_sessions(times_, "k", "t", "20 days"), "2026-02-01 00:00:00")
    assert [(r.k, r.touches) for r in kept.collect()] == [("a", 4)]
