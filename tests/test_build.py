import pytest
from pyspark.sql import functions as F

from graphloom.operators import extraction
from graphloom.plans import build as B
from graphloom.plans import views as V
from graphloom.sources import readers, store

ME = "Mia Owner <mia@home.example>"


def mail(n, sender, to, subject, body, day):
    return f"--- ITEM {n} ---\nsource_type: email\nchannel: email\ntimestamp: {day} Mar 2026 10:00:00 +0000\nfrom / to: from: {sender}\n to: {to}\nsubject: {subject}\nbody:\n```\n{body}\n```\n"


ARCHIVE = "".join(
    [
        mail(1, "Jane Doe <jane@acme.example>", ME, "Registration", "The registration invoice is $970.00 usd, please pay soon my friend.", 1),
        mail(2, "Jane Doe <jane@acme.example>", ME, "Registration", "The registration invoice is $970.00 usd, please pay soon my friend.", 2),
        mail(3, ME, "Jane Doe <jane@acme.example>", "Re: Registration", "Paid by bank, the hotel too: $80.50 for the first night in the city.", 3),
        mail(4, "Bo Li <bo@acme.example>", ME, "Poster", "Our poster session is on Friday and we need a badge for everybody there.", 20),
        mail(5, "Jane Doe <jane.doe@mail.example>", ME, "Hi", "A short note about the weather that has nothing to do with other things.", 21),
        mail(6, "Help Desk <support@acme.example>", ME, "Ticket", "Your ticket was opened and we will come back to you in a few working days.", 22),
        "## Chat: `Garden club` (2 messages)\n",
        "--- ITEM 7 ---\nsource_type: whatsapp\ntimestamp: [05/03/26, 9:31:24 PM]\nfrom / to: Mia Owner\nbody:\n```\nwho brings the seeds on saturday morning to the old garden near the school\n```\n",
        "--- ITEM 8 ---\nsource_type: whatsapp\ntimestamp: [06/03/26, 9:31:24 PM]\nfrom / to: —\nbody:\n```\nok\n```\n",
    ]
)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("archive")
    (at / "batch1.md").write_text(ARCHIVE)
    (at / "ignored.eml").write_text("Subject: x\n\ny")
    return readers.read_archive(spark, str(at))


@pytest.fixture(scope="module")
def bundle(archive):
    return B.build(archive[0])


def test_reading(archive):
    items, report = archive
    rows = items.orderBy("pos").collect()
    assert [r.id for r in rows] == [f"batch1#{n}" for n in range(1, 9)] and [r.pos for r in rows] == list(range(8))
    (r,) = report.collect()
    assert (r.name, r.detected_format, r.status, r["items"]) == ("batch1.md", "markdown", "ok", 8)


def test_duplicates(bundle):
    marked = {r.id: r.duplicate_of for r in bundle.items.collect()}
    assert {k: v for k, v in marked.items() if v} == {"batch1#2": "batch1#1"}
    assert bundle.stats["canonical_items"] == 7 and bundle.stats["exact_dupes"] == 1


def test_people(bundle):
    people = {r.label: r for r in bundle.entities.where("type = 'person'").collect()}
    assert set(people) == {"Mia Owner", "Jane Doe", "Bo Li"}
    assert people["Mia Owner"].owner and people["Jane Doe"].emails == ["jane.doe@mail.example", "jane@acme.example"]
    assert bundle.stats["owner"] == "Mia Owner" and bundle.stats["owner_confident"]
    told = bundle.mentions.join(bundle.items, F.col("item_id") == F.col("id")).where("duplicate_of is not null").count()
    assert told == 0


def test_edges_and_contract(bundle):
    edges = {(r.kind, r.weight) for r in bundle.edges.collect()}
    assert ("corresponded_with", 3.0) in edges and any(k == "affiliated_with" for k, _ in edges)
    from graphloom.operators import contract

    assert contract.check(bundle.graph(), strict=True, owner_confident=True).count() == 0


def test_presets(bundle):
    who = V.run("who", bundle)
    rows = who["table"].collect()
    assert [r.name for r in rows][0] == "Jane Doe" and "Mia Owner" not in [r.name for r in rows]
    money = V.run("money", bundle)
    assert [(float(r.amount), r.currency, r.flagged) for r in money["table"].collect()] == [(970.0, "USD", False), (80.5, "USD", False)]
    assert money["answer"] == "2 amount(s) resolved. Total: 1,050.50 USD"
    steps = [r.text for r in V.run("timeline", bundle)["steps"].collect()]
    assert any(s.startswith("Registration & Payment — 2 item(s)") for s in steps)
    with pytest.raises(KeyError):
        V.run("weather", bundle)
    assert V.starter_questions(bundle).count() == 5 and V.run("who", bundle)["citations"].count() > 0


def test_listings(bundle):
    page, total = V.items_page(bundle, source_type="email", q="REGISTRATION", limit=2)
    assert total == 3 and [r.id for r in page.collect()] == ["batch1#1", "batch1#2"]
    assert V.items_page(bundle, relevant=True)[1] == 8 and V.items_page(bundle, conversation="whatsapp:Garden club")[1] == 2
    row, named = V.item(bundle, "batch1#3")
    assert row.first().recipients == "Jane Doe" and {r.label for r in named.collect()} >= {"Mia Owner", "Jane Doe"}
    jane = bundle.entities.where("label = 'Jane Doe'").first().id
    detail, told = V.entity(bundle, jane)
    assert detail.count() == 1 and told.where("snippet <> ''").count() == told.count() > 2
    assert V.entity_answer(bundle, jane)["answer"] == "Entity: Jane Doe (person)" and "error" in V.entity_answer(bundle, "nobody")
    nodes, links = V.graph_view(bundle)
    assert nodes.where("type = 'person' and degree = 0").count() == 0 and links.count() > 0
    assert V.report(bundle)["unique_after_dedup"] == 7 and V.ingest_stats(bundle).count() == 2
    assert V.node_list(bundle, "jane").first().label == "Jane Doe" and V.merge_list(bundle).count() >= 1


def test_ask(bundle):
    client = extraction.CannedClient(default="Jane sent it [batch1#1], see [nothing] and [batch1#1].")
    found = V.ask(bundle, "What did Jane Doe send about the registration?", client)
    assert "PERSON Jane Doe" in found["subgraph_text"] and found["retrieved"][0] == "batch1#1" and found["citations"] == ["batch1#1"]
    assert V.ask(bundle, "zzz")["subgraph_text"].startswith("RELATIONS")


def test_ids_follow_from_content(bundle, archive):
    again = B.build(archive[0])
    assert sorted(r.id for r in again.entities.collect()) == sorted(r.id for r in bundle.entities.collect())
    assert sorted(r.id for r in again.edges.collect()) == sorted(r.id for r in bundle.edges.collect())


def test_store(spark, bundle, tmp_path):
    path = f"file://{tmp_path}/bundle"
    bundle.save(path)
    bundle.save(path)
    back = B.Bundle.load(spark, f"file://{tmp_path}/none", path)
    assert back.stats == bundle.stats and back.entities.count() == bundle.entities.count()
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "manifest.json").write_text("{")
    assert store.load(spark, f"file://{tmp_path}/broken") is None


def test_claims(spark, archive):
    items = archive[0]
    marked, _, _ = B.prepare(items)
    chunk_rows = B.chunked(marked).collect()
    answers = []
    for c in chunk_rows:
        local = {v: k for k, v in c.id_map.items()}
        if "batch1#1" in local:
            m = local["batch1#1"]
            mention = lambda s, t, e, **clues: {"message_id": m, "surface": s, "type": t, "local_entity": e, "clues": clues}
            answers.append((c.chunk_id, extraction.canned_json({
                "messages": [{"id": m, "topics": ["Conference fees"], "reason": "r"}],
                "mentions": [mention("friend", "person", "jane", email="jane@acme.example"), mention("registration", "org", "reg"), mention("invented", "org", "x"), {**mention("friend", "person", "y"), "message_id": "m99"}],
                "relations": [{"type": "paid", "subject_local_entity": "jane", "object_local_entity": "reg", "message_id": m, "evidence_span": "please pay"}, {"type": "likes", "subject_local_entity": "jane", "object_local_entity": "reg", "message_id": m, "evidence_span": "please pay"}],
            })))
    chunks_df = spark.createDataFrame(chunk_rows, B.chunks.CHUNKS)
    said = spark.createDataFrame(answers, "chunk_id string, answer string")
    _, _, _, rejected = extraction.verify(chunks_df, extraction.parsed(said))
    assert {r.reason: r.n for r in rejected.collect()} == {"surface_not_found": 1, "bad_message_id": 1, "bad_relation_type": 1}
    b = B.build(items, B.verified(chunks_df, said, B.no_clusters))
    assert b.edges.where("kind = 'paid'").count() == 1
    assert b.entities.where("type = 'org' and label = 'registration'").count() == 1
    assert b.relevance.where("item_id = 'batch1#1'").first().topics == ["Conference fees"]
    assert [r.label for r in V.G.topic_episodes(b.items, b.relevance).collect()] == ["Conference fees"]
