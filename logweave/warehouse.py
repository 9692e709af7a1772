"""Tables in one folder that merges change bucket by bucket.

A table is Parquet folders, one for each bucket of a hash of its keys, and a chain of manifests that say which
folders make up a version. A merge reads and rewrites only the buckets that its batch touches; the others are
taken over by name. A version counts once its manifest is there, and a manifest's name can be taken
once: of two writers that began from the same version the second begins again from the first one's outcome.
What a broken write has left belongs to no version, and ``vacuum`` removes it with the old ones.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .operators import merge


@dataclass(frozen=True)
class Rule:
    """How a batch meets a table. ``mutable``: the columns that a known row takes from it; None: all; (): none."""

    keys: tuple[str, ...]
    mutable: tuple[str, ...] | None = None


#: What identifies a row, and what may change of it.
RULES = {
    "guilds": Rule(("guild_id",), ("name", "icon", "raw")),
    "channels": Rule(("channel_id",), ("name", "topic", "position", "last_message_id", "thread_metadata", "message_count", "raw")),
    "roles": Rule(("role_id",), ("name", "color", "raw")),
    "emojis": Rule(("emoji_id",), ("name", "available", "raw")),
    "stickers": Rule(("sticker_id",), ("name", "available", "raw")),
    "events": Rule(("event_id",), ("name", "status", "raw")),
    "users": Rule(("user_id",), None),
    "messages": Rule(("message_id",), ()),
    "attachments": Rule(("attachment_id",), ()),
    "reactions": Rule(("message_id", "emoji_key"), ("count", "count_details", "burst_colors", "raw")),
    "chunks": Rule(("chunk_type", "channel_id", "anchor_id"), ("message_ids", "author_ids", "mentioned_user_ids", "has_attachments", "chunk_state", "embedding_status", "last_message_s", "n_messages")),
    "chunk_texts": Rule(("chunk_id",), None),
    "chunking_checkpoints": Rule(("channel_id",), ("last_message_id",)),
    "vectors": Rule(("chunk_id",), None),
    "bounds": Rule(("channel_id",), None),
    "windows": Rule(("key", "seg_start"), None),
}

#: Parts of what is known of a row that only some runs change.
NEW_CHAINS = Rule(("chunk_type", "channel_id", "anchor_id"), ())
STATUS = Rule(("chunk_type", "channel_id", "anchor_id"), ("embedding_status",))
ENDED = Rule(("chunk_type", "channel_id", "anchor_id"), ("chunk_state",))
STATES = Rule(("key",), None)


def merged(name: str | Rule, table: DataFrame, batch: DataFrame, order: list[str], bucket: str | None = None) -> DataFrame:
    """``table`` after ``batch``, by a rule or the rule of a name; of rows of one key in the batch the last by ``order`` counts,
    or the first where known rows keep all they have. ``bucket``: a column of both that the keys give, which rows are dealt by."""
    rule = name if isinstance(name, Rule) else RULES[name]
    keys, dealt = [*rule.keys, *([bucket] if bucket else [])], [bucket] if bucket else None
    if rule.mutable is None:
        return merge.update_all(table, batch, keys, order, dealt)
    if not rule.mutable:
        return merge.insert_ignore(table, batch, keys, order, dealt)
    return merge.update_some(table, batch, keys, [c for c in rule.mutable if c in table.columns], order, dealt)


#: Buckets of a table that a merge makes; ``rebucket`` changes their number.
BUCKETS = 16
#: How often a merge begins again because another writer was faster.
ATTEMPTS = 20


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")


class Taken(RuntimeError):
    """Another writer has made the version."""


class Warehouse:
    """Tables under ``root``, which any file system of Spark may hold."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm

    def _path(self, *parts: str):
        path = self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._path(*parts)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _remove(self, *parts: str) -> None:
        fs, path = self._path(*parts)
        fs.delete(path, True)

    def _manifest(self, name: str) -> tuple[int, dict | None]:
        """The number of the newest version that was written to its end, and what it says."""
        for version in sorted((int(n[2:]) for n in self._names(name, "manifests") if n.startswith("v=")), reverse=True):
            fs, path = self._path(name, "manifests", f"v={version}")
            file = fs.open(path)
            try:
                told = self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
            finally:
                file.close()
            if told.endswith("\n"):
                return version, json.loads(told)
        return 0, None

    def _commit(self, name: str, version: int, manifest: dict) -> None:
        fs, path = self._path(name, "manifests", f"v={version}")
        try:
            file = fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Taken(f"{name} has a version {version}") from None
            raise
        file.write(bytearray(json.dumps(manifest).encode() + b"\n"))
        file.close()

    def holds(self, folder: str) -> bool:
        """Whether there is anything in a folder that is no table, as the log."""
        return bool(self._names(folder))

    def tables(self) -> list[str]:
        fs, path = self._path()
        return sorted(n for n in self._names() if fs.exists(self._jvm.org.apache.hadoop.fs.Path(path, f"{n}/manifests")))

    def has(self, name: str) -> bool:
        return self._manifest(name)[1] is not None

    def version(self, name: str) -> int:
        return self._manifest(name)[0]

    def rewritten(self, name: str) -> list[str]:
        """The buckets that the newest version has of its own."""
        return (self._manifest(name)[1] or {}).get("rewritten", [])

    def _read(self, name: str, manifest: dict, buckets: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.root}/{name}/{f}" for b, f in manifest["files"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        manifest = self._manifest(name)[1]
        if manifest is None:
            raise LookupError(f"there is no table {name} under {self.root}")
        return self._read(name, manifest)

    def _written(self, name: str, df: DataFrame, keys: list[str], buckets: int) -> dict[str, str]:
        """Write rows under a name of their own; the folder of each bucket that has rows. Rows with ``_bucket`` are dealt by it already."""
        folder = f"data/{uuid.uuid4().hex}"
        if not keys:
            df.write.parquet(f"{self.root}/{name}/{folder}")
            return {"all": folder}
        if "_bucket" not in df.columns:
            df = df.select("*", _bucket(keys, buckets)).repartition("_bucket")
        df.write.partitionBy("_bucket").parquet(f"{self.root}/{name}/{folder}")
        return {n.removeprefix("_bucket="): f"{folder}/{n}" for n in self._names(name, folder) if n.startswith("_bucket=")}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """A version of these rows alone."""
        version, old = self._manifest(name)
        keys, buckets = (old or {}).get("keys", []), (old or {}).get("buckets", self.buckets)
        files = self._written(name, df, keys, buckets)
        self._commit(name, version + 1, {"schema": json.loads(df.schema.json()), "keys": keys, "buckets": buckets, "files": files, "rewritten": sorted(files)})
        return self.read(name)

    def merge(self, name: str, batch: DataFrame, order: list[str], rule: Rule | None = None, held: bool = False) -> DataFrame:
        """Merge a batch by a rule, that of the table's name if none is given; ``order`` names columns of the batch, of which those with a leading underscore are not kept.

        Rows of the table and of the batch are shuffled once, by bucket. ``held``: the batch is in files already, so that reading it twice is cheap.
        """
        rule = rule or RULES[name]
        keys, folder = list(rule.keys), None
        for _ in range(ATTEMPTS):
            version, old = self._manifest(name)
            if old is None:
                schema = batch.drop(*[c for c in order if c.startswith("_")]).schema
                old = {"schema": json.loads(schema.json()), "keys": keys, "buckets": self.buckets, "files": {}}
            elif old["keys"] != keys:
                raise ValueError(f"{name} is bucketed by {old['keys']}, not by {keys}")
            bucket, touched = _bucket(keys, old["buckets"]), set()
            if old["files"]:
                if not held and folder is None:  # read twice below, and again if another writer is faster
                    folder = f"incoming/{uuid.uuid4().hex}"
                    batch.write.parquet(f"{self.root}/{name}/{folder}")
                    batch = self.spark.read.schema(batch.schema).parquet(f"{self.root}/{name}/{folder}")
                touched = {str(r[0]) for r in batch.select(bucket).distinct().collect()}  # as many as buckets at most
            table = self._read(name, old, touched).select("*", bucket)
            files = self._written(name, merged(rule, table, batch.select("*", bucket), order, "_bucket"), keys, old["buckets"])
            try:
                self._commit(name, version + 1, old | {"files": old["files"] | files, "rewritten": sorted(files)})
            except Taken:
                continue
            if folder:
                self._remove(name, folder)
            return self.read(name)
        raise Taken(f"{name} was changed by others {ATTEMPTS} times")

    def rebucket(self, name: str, buckets: int, keys: list[str] | None = None) -> DataFrame:
        """The same rows in another number of buckets, or by other keys."""
        version, old = self._manifest(name)
        keys = old["keys"] if keys is None else keys
        files = self._written(name, self._read(name, old), keys, buckets)
        self._commit(name, version + 1, old | {"keys": keys, "buckets": buckets, "files": files, "rewritten": sorted(files)})
        return self.read(name)

    def vacuum(self, name: str) -> int:
        """Remove all but the newest version, and what belongs to none; how many folders went. No writer may be at work meanwhile."""
        version, manifest = self._manifest(name)
        used = {f.split("/")[1] for f in (manifest or {"files": {}})["files"].values()}
        gone = [("data", n) for n in self._names(name, "data") if n not in used] + [("incoming", n) for n in self._names(name, "incoming")]
        # A folder goes as a whole; of one that is in use the buckets that later versions have replaced go.
        kept = set((manifest or {"files": {}})["files"].values())
        for folder in used:
            gone += [("data", folder, n) for n in self._names(name, "data", folder) if n.startswith("_bucket=") and f"data/{folder}/{n}" not in kept]
        for parts in gone:
            self._remove(name, *parts)
        for n in self._names(name, "manifests"):
            if n != f"v={version}" and n.startswith("v="):
                self._remove(name, "manifests", n)
        return len(gone)
