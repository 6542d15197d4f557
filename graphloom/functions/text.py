"""Text normalisers, keys and tokens as column expressions (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.schema import SOURCE_TYPES, STOP_WORDS

ColumnOrName = Column | str

# Invisible direction marks and the no-break space, deleted (not replaced) before matching.
INVISIBLE = "[\\u200e\\u200f\\u202a-\\u202e\\u2066-\\u2069\\u00a0]"
# White space as Python's str.strip and \s see it.
SPACE = "[\\s\\x1c-\\x1f\\x85\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: ColumnOrName) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), f"{SPACE}+", " "))


def visible(c: ColumnOrName) -> Column:
    """without invisible marks, white space collapsed, case kept."""
    return collapse(F.regexp_replace(F.coalesce(_col(c), F.lit("")), INVISIBLE, ""))


def normalize(c: ColumnOrName) -> Column:
    """the form in which texts are compared."""
    return F.lower(visible(c))


def words(c: ColumnOrName) -> Column:
    """The words of a normalised text, in order, repeats kept."""
    return F.regexp_extract_all(normalize(c), F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1))


def shingles(tokens: Column, k: int = 3) -> Column:
    """the distinct k-word shingles of a token array; a shorter text is one shingle, an empty one none."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - (k - 1)))
    made = F.transform(starts, lambda a: F.array_join(F.slice(tokens, a, k), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(made))


def content_hash(sender: ColumnOrName, subject: ColumnOrName, body: ColumnOrName) -> Column:
    """What makes two items exact copies; time and conversation do not count."""
    parts = [F.coalesce(_col(c), F.lit("")) for c in (sender, subject, body)]
    return F.sha2(normalize(F.concat_ws("\n", *parts)), 256)


def _letters(c: ColumnOrName, keep: str, put: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), f"[^{keep}]", put), " +", " "))


def label_key(c: ColumnOrName) -> Column:
    """The key of a label: a-z, 0-9 and single spaces."""
    return _letters(c, "a-z0-9 ", " ")


def person_key(c: ColumnOrName) -> Column:
    """The key of a person's name: its words of two letters or more, sorted."""
    long = F.filter(F.split(_letters(c, "a-z ", " "), " "), lambda t: F.length(t) > 1)
    return F.array_join(F.array_sort(long), " ")


def blocking_key(c: ColumnOrName) -> Column:
    """A name as blocking compares it: other characters are deleted, not replaced."""
    return _letters(c, "a-z ", "")


def report_key(c: ColumnOrName) -> Column:
    """A label as the report compares it."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9]+", " "))


def query_tokens(c: ColumnOrName) -> Column:
    """distinct words of two characters or more that are no stop words."""
    kept = F.filter(F.split(label_key(c), " "), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))
    return F.array_distinct(kept)


def email_stem(c: ColumnOrName) -> Column:
    """the letters of an address's local part."""
    return F.regexp_replace(F.lower(F.substring_index(_col(c), "@", 1)), "[^a-z]", "")


def email_domain(c: ColumnOrName) -> Column:
    """what follows the last @, lower case; null where there is none."""
    c = _col(c)
    return F.when(c.contains("@"), F.lower(F.substring_index(c, "@", -1)))


def name_tokens(c: ColumnOrName, least: int = 4) -> Column:
    """the words of a name that say something, by length."""
    return F.array_distinct(F.filter(F.split(blocking_key(c), " "), lambda t: F.length(t) >= least))


def first_name(c: ColumnOrName) -> Column:
    return F.nullif(F.get(F.split(blocking_key(c), " "), F.lit(0)), F.lit(""))


def is_role_mailbox(email: Column, names: tuple[str, ...] | list[str]) -> Column:
    """Whether an address's local part, without dots and plus signs, is that of an automated sender."""
    return F.regexp_replace(F.lower(F.substring_index(email, "@", 1)), "[.+]", "").isin(*names)


def stable_id(kind: ColumnOrName, key: ColumnOrName) -> Column:
    """type and ten hex digits of the key's SHA-1."""
    return F.concat(_col(kind), F.lit(":"), F.left(F.sha1(_col(key).cast("binary")), F.lit(10)))


def normalize_subject(c: ColumnOrName) -> Column:
    """without stacked reply prefixes and bracket tags, lower case."""
    prefix = f"^({SPACE}*(?i:(re|fwd|fw){SPACE}*[:\\-]|\\[(resend|urgent|reminder)\\]){SPACE}*)+"
    stripped = F.regexp_replace(F.coalesce(_col(c), F.lit("")), prefix, "")
    return F.lower(F.regexp_replace(stripped, f"^{SPACE}+|{SPACE}+$", ""))


def source_type(raw: ColumnOrName) -> Column:
    """The first source type that the text begins with, else other."""
    low = F.lower(F.trim(F.coalesce(_col(raw), F.lit(""))))
    found = F
    for t in SOURCE_TYPES:
        found = found.when(low.startswith(t), F.lit(t))
    return found.otherwise("other")


def conversation_id(kind: ColumnOrName, channel: ColumnOrName, section: ColumnOrName, subject: ColumnOrName) -> Column:
    """Chats by section, mail by subject, anything else by channel."""
    kind, channel, section, subject = _col(kind), _col(channel), F.nullif(_col(section), F.lit("")), F.nullif(_col(subject), F.lit(""))
    return (
        F.when(kind == "whatsapp", F.trim(F.concat(F.lit("whatsapp:"), F.coalesce(section, channel, F.lit("")))))
        .when((kind == "email") & subject.isNotNull(), F.concat(F.lit("email-thread:"), normalize_subject(subject)))
        .otherwise(F.coalesce(F.nullif(channel, F.lit("")), section, F.lit("")))
    )


def clean_section(c: ColumnOrName) -> Column:
    """A section title without backticks, message count and the word Chat."""
    bare = F.regexp_replace(_col(c), "^[\\s`]+|[\\s`]+$", "")
    counted = F.regexp_replace(bare, "\\s*\\(\\d+\\s+messages?\\)\\s*$", "")
    return F.regexp_replace(F.regexp_replace(counted, "(?i)^Chat:\\s*", ""), "^[\\s`]+|[\\s`]+$", "")


# ---- participants of an item (arrays of schema.PARTICIPANT) ----


def senders(participants: ColumnOrName = "participants") -> Column:
    """P01."""
    return F.filter(_col(participants), lambda p: p["role"] == "sender")


def addressees(participants: ColumnOrName = "participants") -> Column:
    """P01."""
    return F.filter(_col(participants), lambda p: p["role"].isin("recipient", "cc"))


def _first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def shown(p: Column) -> Column:
    """How a participant is shown: name, else as written, else identifier."""
    return _first_of(p["display_name"], p["raw"], p["id_value"])


def sender_display(participants: ColumnOrName = "participants") -> Column:
    """P02."""
    return F.coalesce(shown(F.get(senders(participants), F.lit(0))), F.lit(""))


def recipients_display(participants: ColumnOrName = "participants") -> Column:
    """P03."""
    return F.array_join(F.filter(F.transform(addressees(participants), shown), lambda s: s != ""), ", ")


def emails(participants: ColumnOrName = "participants") -> Column:
    """P04."""
    held = F.filter(_col(participants), lambda p: (p["id_type"] == "email") & (F.coalesce(p["id_value"], F.lit("")) != ""))
    return F.transform(held, lambda p: p["id_value"])


def party_key(p: Column) -> Column:
    """what tells participants of a conversation apart."""
    return F.trim(F.lower(_first_of(p["id_value"], p["display_name"], p["raw"])))


def best_label(names: Column, emails_: Column) -> Column:
    """The name with most words, then the longest, then the first in order; else the first address."""
    real = F.filter(names, lambda n: ~n.contains("@") & (F.length(n) > 1))
    ranked = F.array_sort(F.transform(real, lambda n: F.struct((-F.size(F.split(F.trim(n), f"{SPACE}+"))).alias("w"), (-F.length(n)).alias("l"), n.alias("n"))))
    return F.coalesce(F.get(ranked, F.lit(0))["n"], F.get(F.array_sort(emails_), F.lit(0)), F.lit("unknown"))


def snippet(subject: ColumnOrName, body: ColumnOrName, body_length: int = 100, length: int = 120) -> Column:
    """A citation's text."""
    return F.left(F.trim(_first_of(_col(subject), F.left(_col(body), F.lit(body_length)))), F.lit(length))


def strip_lines(body: ColumnOrName, drop: Column) -> Column:
    """the lines that are not in an array of boilerplate lines."""
    return F.array_join(F.filter(F.split(_col(body), "\n"), lambda line: ~F.array_contains(drop, F.trim(line))), "\n")


def message_time(timestamp: ColumnOrName, raw: ColumnOrName) -> Column:
    """F29."""
    return F.coalesce(F.date_format(_col(timestamp), "yyyy-MM-dd'T'HH:mm:ss"), F.nullif(F.left(_col(raw), F.lit(20)), F.lit("")), F.lit("?"))


def token_estimate(text: ColumnOrName, chars_per_token: float = 3.5) -> Column:
    """F32."""
    return F.greatest(F.lit(1), F.floor(F.length(_col(text)) / chars_per_token).cast("int"))
