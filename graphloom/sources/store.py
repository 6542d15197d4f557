"""Bundles on disk: a Parquet directory per table, named by a manifest that is written last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.scratch import delete

SCHEMA_VERSION = 1


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def save(spark: SparkSession, tables: dict[str, DataFrame], path: str, stats: dict | None = None) -> str:
    """Write all tables to a fresh version directory, then point the manifest at it. Readers see the old bundle
    or the new one, never a mixture; a failed write leaves the old one in place."""
    version = f"{path}/v-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{version}/{name}")
    manifest = json.dumps({"schema_version": SCHEMA_VERSION, "version": version.rsplit("/", 1)[1], "tables": sorted(tables), "stats": stats or {}}, sort_keys=True)
    fs, target = _fs(spark, f"{path}/manifest.json")
    _, new = _fs(spark, f"{path}/manifest.json.new")
    out = fs.create(new, True)
    out.write(bytearray(manifest.encode()))
    out.close()
    before = _manifest(spark, path)
    fs.delete(target, False)
    fs.rename(new, target)
    # readers may still hold the version before; those before it go
    keep = {version.rsplit("/", 1)[1], before["version"] if before else ""}
    for entry in fs.listStatus(fs.makeQualified(target.getParent())):
        name = entry.getPath().getName()
        if name.startswith("v-") and name not in keep:
            delete(spark, f"{path}/{name}")
    return version


def _manifest(spark: SparkSession, path: str) -> dict | None:
    fs, at = _fs(spark, f"{path}/manifest.json")
    if not fs.exists(at):
        fs, at = _fs(spark, f"{path}/manifest.json.new")  # a writer stopped between delete and rename
        if not fs.exists(at):
            return None
    try:
        found = json.loads("\n".join(r.value for r in spark.read.text(at.toString(), wholetext=True).collect()))
    except ValueError:
        return None
    return found if found.get("schema_version") == SCHEMA_VERSION else None


def load(spark: SparkSession, *paths: str) -> tuple[dict[str, DataFrame], dict] | None:
    """The first bundle in order that can be read, and its stats; None if there is none."""
    for path in paths:
        found = _manifest(spark, path)
        if found:
            try:
                return {t: spark.read.parquet(f"{path}/{found['version']}/{t}") for t in found["tables"]}, found["stats"]
            except Exception:  # noqa: BLE001  a broken bundle counts as none
                continue
    return None


def keep_raw(files: DataFrame, path: str) -> None:
    """Raw files (name, content) added to a folder, to be read again later. Files added twice under a name stay once, the last."""
    files.select("name", "content", F.current_timestamp().alias("kept_at")).write.mode("append").parquet(path)


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """The raw files (name, content) of a folder."""
    return spark.read.parquet(path).groupBy("name").agg(F.max_by("content", "kept_at").alias("content"))


def overlaid(tables: dict[str, DataFrame], changes: dict[str, DataFrame], keys: dict[str, str]) -> dict[str, DataFrame]:
    """The tables with a session's changed rows over them, by key. The tables themselves are shared and never written: a session
    costs the rows that it changes."""
    out = dict(tables)
    for name, changed in changes.items():
        key = keys[name]
        out[name] = tables[name].join(changed.select(key), key, "left_anti").unionByName(changed)
    return out
