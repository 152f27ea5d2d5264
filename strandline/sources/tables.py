"""Reading and writing: Parquet, CSV, JSON lines, file inventory, idempotent stages."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File kinds by suffix.
KINDS = {".parquet": "table", ".csv": "table", ".jsonl": "records", ".json": "document", ".yaml": "config", ".yml": "config", ".png": "image", ".jpg": "image", ".mp4": "video"}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_metadata(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON document per file, with the file's name."""
    return spark.read.json(folder, schema=schema, multiLine=True).withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))


def write_both(df: DataFrame, path: str, public: list[str]) -> None:
    """Parquet with all columns, and CSV with the public ones."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.select(*public).write.mode("overwrite").csv(f"{path}/csv", header=True)


def inventory(spark: SparkSession, root: str, skip: tuple[str, ...] = ("_temporary", ".cache")) -> DataFrame:
    """path, suffix, kind, size, sha256 and id (kind and first 12 digits) of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    for part in skip:
        files = files.where(~F.col("path").contains(f"/{part}/"))
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    kind = F.coalesce(F.try_element_at(kinds, suffix), F.lit("other"))
    digest = F.sha2("content", 256)
    return files.select("path", suffix.alias("suffix"), kind.alias("kind"), F.col("length").alias("size"), digest.alias("sha256"), F.concat_ws("_", kind, F.substring(digest, 1, 12)).alias("file_id"))


def stable_hash(document) -> str:
    """SHA-256 of canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def deep_merge(base: dict, over: dict) -> dict:
    """over into base, dictionaries key by key; neither is changed."""
    out = dict(base)
    for key, value in over.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def dotted(config: dict, path: str, default=None):
    """config['a']['b'] for 'a.b'."""
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def stage(spark: SparkSession, path: str, config: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """build() written under a folder named by the config's fingerprint; a finished one is read instead."""
    place = str(PurePosixPath(path) / stable_hash(config)[:16]) if "://" not in path else f"{path.rstrip('/')}/{stable_hash(config)[:16]}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def remaining(all_keys: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that aren't done yet."""
    return all_keys.join(done.select(*keys), keys, "left_anti")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, size and modified of every file below root; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))


def hashed(spark: SparkSession, root: str, cache: DataFrame) -> DataFrame:
    """path, size, modified and sha256 of every file below root; known ones come from cache(path, size, modified, sha256).

    Only files that the cache doesn't have as they are now are read. Their paths go through the
    driver, which lists files for any scan.
    """
    now, key = listing(spark, root), ["path", "size", "modified"]
    known = now.join(cache.select(*key, "sha256"), key)
    missing = [r["path"] for r in now.join(cache.select(*key), key, "left_anti").select("path").collect()]
    if not missing:
        return known
    read = spark.read.format("binaryFile").load(missing)
    fresh = read.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    return known.unionByName(fresh)


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """name (the path below root) and sha256 of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = PurePosixPath(root).name + "/"
    return files.select(F.substring_index("path", base, -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def changed_files(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """name and what happened to it since the manifest: added, removed or changed."""
    both = now.alias("a").join(manifest.alias("b"), F.col("a.name") == F.col("b.name"), "full")
    what = F.when(F.col("b.name").isNull(), "added").when(F.col("a.name").isNull(), "removed").when(F.col("a.sha256") != F.col("b.sha256"), "changed")
    return both.select(F.coalesce("a.name", "b.name").alias("name"), what.alias("what")).where("what is not null")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside its place, then renamed."""
    jvm = spark.sparkContext._jvm
    place, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(beside, place):
        fs.delete(beside, False)
        raise OSError(f"{path} can't be written")
