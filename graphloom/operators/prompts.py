"""What a client is asked: instructions, their versions, and the shape of the answers.

The shape comes from the Spark schema that answers are parsed with, so the two cannot drift apart; a version follows from instructions
and shape, so that kept answers are asked for again when either changes.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from graphloom.schema import EXTRACTION, MENTION_TYPES, RELATION_TYPES, RESOLUTION

EXTRACT = """You read one stretch of a conversation: a table of its participants, then its messages, each behind an id in angle brackets.
Say which topics each message is about, who and what it mentions, and how those are related. Quote every mention and every evidence span
from its message exactly as written; leave out what you cannot quote. Use the ids of the messages, and a short name of your own for each
thing that is mentioned, the same one whenever it is meant. Answer with one JSON object of the given shape and nothing else."""
RESOLVE = """You get profiles of people, organisations or places from different conversations. Say which profiles stand for one and the same:
list them as clusters, each with the profile ids, a name that one of them uses, how sure you are (high, medium or low) and why. Put profiles
together only if their identifiers or their names and surroundings agree; leave a profile out rather than guess. Answer with one JSON object
of the given shape and nothing else."""
ANSWER = """You answer a question about an archive from the part of its graph and the source items below, and from nothing else. Put the id of
every item that you use in square brackets behind what it shows. Say so if the items do not answer the question."""

#: Values that a field may have, by the path of its name.
ALLOWED = {"mentions.type": MENTION_TYPES, "relations.type": RELATION_TYPES, "clusters.confidence": ("high", "medium", "low")}


def shape(kind: DataType, path: str = "") -> dict:
    """The JSON schema of a Spark type."""
    if isinstance(kind, StructType):
        fields = {f.name: shape(f.dataType, f"{path}.{f.name}".strip(".")) for f in kind.fields}
        return {"type": "object", "properties": fields, "required": [n for n, f in fields.items() if f["type"] != "object" or "properties" in f]}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": shape(kind.elementType, path)}
    if isinstance(kind, MapType):
        return {"type": "object", "additionalProperties": shape(kind.valueType)}
    return {"type": "string" if isinstance(kind, StringType) else kind.typeName()} | ({"enum": list(ALLOWED[path])} if path in ALLOWED else {})


def tool(name: str) -> dict:
    """The instructions, shape and version of a call: extract, resolve or answer."""
    system, ddl = {"extract": (EXTRACT, EXTRACTION), "resolve": (RESOLVE, RESOLUTION), "answer": (ANSWER, None)}[name]
    schema = shape(DataType.fromDDL(ddl)) if ddl else None
    version = hashlib.sha256(f"{system}\n{json.dumps(schema, sort_keys=True)}".encode()).hexdigest()[:8]
    return {"name": name, "system": system, "schema": schema, "version": version}


def fields(spark: SparkSession, name: str) -> DataFrame:
    """(path, type, allowed) of every field of a call's answer."""
    rows: list[tuple[str, str, str]] = []

    def visit(node: dict, path: str) -> None:
        rows.append((path, node["type"], "|".join(node.get("enum", []))))
        for key, sub in node.get("properties", {}).items():
            visit(sub, f"{path}.{key}".strip("."))
        if "items" in node:
            visit(node["items"], f"{path}[]")

    visit(tool(name)["schema"], "")
    return spark.createDataFrame(rows, "path string, type string, allowed string").where(F.col("path") != "")
