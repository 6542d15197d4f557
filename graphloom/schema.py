"""Spark schemas of the archive's tables, and the fixed vocabularies shared by operators."""

from __future__ import annotations

PARTICIPANT = (
    "struct<display_name: string, id_type: string, id_value: string, raw: string, role: string, kind: string, descriptors: array<string>>"
)
ITEMS = (
    "id string, pos long, source_type string, channel string, conversation_id string, timestamp_raw string, "
    f"timestamp timestamp, participants array<{PARTICIPANT}>, subject string, body string, notes string, "
    "provenance struct<batch_file: string, item_index: int, section: string>, content_hash string, duplicate_of string"
)
INGEST_FILES = "name string, detected_format string, status string, items int, warnings array<string>, error string"

MENTION = "struct<item_id: string, text: string>"
ATTRS = (
    "struct<emails: array<string>, owner: boolean, domain: string, member_person_ids: array<string>, amount: decimal(18,2), currency: string, "
    "currency_resolved: boolean, currency_evidence: array<string>, currency_ambiguous: boolean, needs_review: boolean, "
    "snippets: array<string>, full_label: string, resolved_by: string>"
)
ENTITIES = f"id string, pos long, type string, label string, aliases array<string>, mentions array<{MENTION}>, attrs {ATTRS}"
EDGES = "id string, pos long, source string, target string, kind string, weight double, evidence_item_ids array<string>"
MERGES = "canonical_id string, merged_forms array<string>, rationale string"
RELEVANCE = "item_id string, relevant boolean, score double, rationale string, topics array<string>"
TIMELINE = "label string, entity_id string, start timestamp, end timestamp, count long"
CHUNKS = (
    "chunk_id string, conversation_id string, chunk_index int, participant_table string, message_lines array<string>, id_map map<string,string>"
)
PROFILES = (
    "id string, pos long, type string, surfaces map<string,long>, identifiers array<string>, clues map<string,array<string>>, "
    "channels array<string>, item_ids array<string>, sample_lines array<string>, co_profile_ids array<string>"
)
EXTRACTION = (
    "struct<messages: array<struct<id: string, topics: array<string>, reason: string>>, "
    "mentions: array<struct<message_id: string, surface: string, type: string, participant_id: string, local_entity: string, clues: map<string,string>>>, "
    "relations: array<struct<type: string, subject_local_entity: string, object_local_entity: string, message_id: string, evidence_span: string>>>"
)
RESOLUTION = (
    "struct<clusters: array<struct<member_ids: array<string>, canonical_name: string, confidence: string, evidence: string>>, "
    "derived_relations: array<struct<subject_id: string, object_id: string, type: string, evidence: string>>>"
)

# The vocabularies that the data contract names.
ENTITY_TYPES = ("person", "org", "location", "money", "document", "subevent")
EDGE_KINDS = ("corresponded_with", "affiliated_with", "paid_to", "held_at", "document_for", "on_date", "paid")
SOURCE_TYPES = ("email", "whatsapp", "sms", "pdf", "image", "excel_row", "other")
MENTION_TYPES = ("person", "org", "location", "money", "document", "event", "unknown")
RELATION_TYPES = ("works_at", "paid", "sent_document", "located_in", "organizes", "attends", "member_of", "booked")
# Local parts of automated senders, as merging knows them. The query side leaves out do-not-reply.
ROLE_MAILBOXES = (
    "noreply", "no-reply", "donotreply", "do-not-reply", "notifications",
    "support", "help", "info", "contact", "team", "hello", "hi",
    "admin", "postmaster", "mailer-daemon", "listserv", "bounce",
    "newsletter", "updates", "alerts", "news", "sales", "marketing",
)
# Mail domains that stand for no organisation.
PERSONAL_DOMAINS = (
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.in", "hotmail.com",
    "outlook.com", "live.com", "icloud.com", "proton.me", "protonmail.com", "aol.com",
)
# Words that a question shares with anything.
STOP_WORDS = (
    "the a an of to in on for and or is are was were be been with at by from as it this that these those i you he she we "
    "they my your our what when where who how did do does me about into out over under"
).split()
# The kinds of subevent and the words that show them.
SUBEVENT_WORDS = {
    "Acceptance": ["accept", "acceptance", "submission", "notification"],
    "Registration & Payment": ["registration", "register", "invoice", "receipt", "payment"],
    "Travel": ["flight", "boarding", "itinerary", "airline", "visa", "passport"],
    "Accommodation": ["airbnb", "accommodation", "hotel", "check-in", "hostel"],
    "Presentation": ["presentation", "poster", "badge", "session", "workshop"],
}
EVIDENCE_LIMIT = 20
FORMS_LIMIT = 12
LABEL_LIMIT = 120
