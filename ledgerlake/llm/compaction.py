"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards. Shards of similar size form a tier (sizes within a factor of `fanout`);
when a tier has `fanout` shards, they are merged into files of about the target size. compact() plans all merges that
are due, through all tiers - a merged shard counts in the tier of its size before it is written, so a row is rewritten
once a call, not once a tier - runs them at the same time, each without a shuffle, and publishes one version with all of
them. Small files (below half the target) of a shard of any size are gathered in the same way; larger ones stay.

A version is a manifest: the schema and the shards with their files. It is published atomically under the next number
(manifest.Manifests), so a reader sees the shards from before a merge or those from after it, never both. A writer
carries the version that it read; if another one was published meanwhile, it takes that one and applies its change to
it: an append adds its shards, a merge takes out the shards that it read and puts its own in. A merge of which a shard is
gone by then is given up and its files are deleted. So no append is lost.

Files that the last `keep_versions` versions don't name are deleted once the version that dropped them is older than
`grace_seconds`, so readers that planned on an older version can end. A job that dies leaves files that no manifest names;
sweep() deletes those.

Defined cases: rows keep all columns, nulls and repeats, whatever the columns' names; arrivals may bring new columns (null
in older rows), not other types of old ones; an empty arrival publishes nothing, except that the first one sets the
schema; a store without rows reads as an empty table.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.manifest import Conflict, Manifests

#: Files in one broadcast table of read_placed(): some 15 MB.
FILES_AT_ONCE = 100_000


@dataclass(frozen=True)
class Tiers:
    target_bytes: int = 128 << 20
    fanout: int = 4
    smallest: int = 1 << 20
    keep_versions: int = 2
    grace_seconds: float = 3600
    at_once: int = 8  #: merges that run at the same time

    def tier(self, size: int) -> int:
        """0 up to `smallest` times fanout, then one more for each factor; shards of the target size aren't merged again (-1)."""
        if size >= self.target_bytes * 3 // 4:
            return -1
        t, top = 0, self.smallest * self.fanout
        while size >= top:
            t, top = t + 1, top * self.fanout
        return t


def due_merges(sizes: list[int], tiers: Tiers) -> list[list[int]]:
    """Which shards to merge now, in groups, oldest first: of each tier as many times `fanout` as it has, from the lowest
    tier on; what a group amounts to counts in the tier above."""
    waiting: dict[int, list[tuple[int, list[int]]]] = {}
    for i, size in enumerate(sizes):
        if (t := tiers.tier(size)) >= 0:
            waiting.setdefault(t, []).append((size, [i]))
    done = []
    while waiting:
        t = min(waiting)
        own = sorted(waiting.pop(t), key=lambda x: x[1])
        while len(own) >= tiers.fanout:
            group, own = own[: tiers.fanout], own[tiers.fanout :]
            size, members = sum(s for s, _ in group), sorted(i for _, g in group for i in g)
            above = tiers.tier(size)
            if above < 0:
                done.append(members)
            elif above == t:  # of very small shards
                own.append((size, members))
            else:
                waiting.setdefault(above, []).append((size, members))
        done += [g for _, g in own if len(g) > 1]
    return sorted(done)


def small_files(shard: dict, tiers: Tiers) -> list[int]:
    """Which files of a shard to gather: those below half the target size, if there are several. Fewer files take their place, so gathering ends."""
    small = [i for i, n in enumerate(shard["sizes"]) if 2 * n < tiers.target_bytes]
    return small if len(small) > 1 else []


def _key(path: str) -> str:
    """A file's folder and name: what it is known by, however its path is written."""
    return "/".join(path.rsplit("/", 2)[1:])


def _folder(path: str) -> str:
    """The folder of the job that wrote a file."""
    return path.rsplit("/data/", 1)[1].split("/", 1)[0]


def _widened(old: StructType | None, new: StructType) -> StructType:
    if old is None:
        return StructType([StructField(f.name, f.dataType) for f in new])
    known = {f.name: f.dataType for f in old}
    for f in new:
        if f.name in known and known[f.name] != f.dataType:
            raise ValueError(f"column {f.name} is {known[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return StructType([*old.fields, *(StructField(f.name, f.dataType) for f in new if f.name not in known)])


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, tiers: Tiers = Tiers()):
        self.spark, self.root, self.tiers = spark, root.rstrip("/"), tiers
        self.manifests = Manifests(spark, root)

    # versions

    def _state(self, version: int | None = None) -> tuple[int, dict]:
        version = self.manifests.latest() if version is None else version
        return version, self.manifests.read(version) if version else {}

    def shards(self, version: int | None = None) -> list[dict]:
        return self._state(version)[1].get("shards", [])

    def schema(self, version: int | None = None) -> StructType | None:
        told = self._state(version)[1].get("schema")
        return StructType.fromJson(told) if told else None

    def _publish(self, base: int, content: dict, change: Callable[[dict], dict | None]) -> int | None:
        """Publishes change(content) as the version after base, or after a later one if others were published; None if the change no longer applies."""
        while True:
            new = change(content)
            if new is None:
                return None
            try:
                version = self.manifests.publish(base + 1, new | {"version": base + 1})
            except Conflict:
                base, content = self._state()
                continue
            self.expire()
            return version

    def expire(self) -> int:
        """Deletes versions beyond the kept ones and their grace time, and files that only they name; how many files went."""
        every = self.manifests.versions()
        kept = every[-max(1, self.tiers.keep_versions) :]
        now = time.time()
        gone = [v for v, after in zip(every, every[1:]) if v not in kept and now - self.manifests.published(after) >= self.tiers.grace_seconds]
        if not gone:
            return 0
        # versions expire in order, and a file that a version dropped doesn't come back in a later one
        files = lambda v: {f for s in self.shards(v) for f in s["files"]}
        live = files(every[len(gone)])
        dead = set().union(*map(files, gone)) - live
        used = {f.rsplit("/", 1)[0] for f in live}
        for path in {f if f.rsplit("/", 1)[0] in used else f.rsplit("/", 1)[0] for f in dead}:
            self.manifests.delete(path)
        for v in gone:
            self.manifests.drop(v)
        return len(dead)

    def sweep(self, older_than_seconds: float = 86_400) -> int:
        """Deletes folders of data that no version names and that are older than any job still running; how many went."""
        named = {_folder(f) for v in self.manifests.versions() for s in self.shards(v) for f in s["files"]}
        gone = [p for p, at in self.manifests.folders(f"{self.root}/data") if p.rsplit("/", 1)[1] not in named and time.time() - at >= older_than_seconds]
        for p in gone:
            self.manifests.delete(p)
        return len(gone)

    # writes

    def _listed(self, folders: list[str]) -> dict[str, list[tuple[str, int, int]]]:
        """Of written folders the files that have rows: path, bytes, rows (one job counts them, from the footers)."""
        files = {f: self.manifests.files(f) for f in folders}
        every = [x for own in files.values() for x, _ in own]
        rows = {}
        if every:
            at = F.substring_index("_metadata.file_path", "/", -2)
            rows = {r["at"]: r["count"] for r in self.spark.read.parquet(*every).groupBy(at.alias("at")).count().collect()}
            if strange := rows.keys() - {_key(f) for f in every}:
                raise RuntimeError(f"files with rows that weren't listed: {sorted(strange)[:3]}")
        return {folder: [(f, n, k) for f, n in own if (k := rows.get(_key(f), 0))] for folder, own in files.items()}

    @staticmethod
    def _shard(files: list[tuple[str, int, int]], merges: int) -> dict:
        return {"id": uuid.uuid4().hex, "files": [f for f, _, _ in files], "sizes": [n for _, n, _ in files], "file_rows": [k for _, _, k in files], "bytes": sum(n for _, n, _ in files), "rows": sum(k for _, _, k in files), "merges": merges}

    def append(self, arrivals: DataFrame, by: Column | None = None) -> int:
        """Appends an arrival as one shard; by: as one shard for each value, all in one version. One job writes them, with the rows of a value brought together (a large value over several tasks)."""
        base, content = self._state()
        _widened(self.schema(base), arrivals.schema)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        if by is None:
            arrivals.write.option("compression", "zstd").parquet(folder)
            folders = [folder]
        else:
            name = "_arrival"
            while name in arrivals.columns:
                name += "_"
            arrivals.withColumn(name, F.xxhash64(by)).hint("rebalance", name).write.partitionBy(name).option("compression", "zstd").parquet(folder)
            folders = [p for p, _ in self.manifests.folders(folder)]
        new = [self._shard(own, 0) for own in self._listed(folders).values() if own]
        if not new and content.get("schema"):
            self.manifests.delete(folder)
            return base

        def added(now: dict) -> dict:
            old = StructType.fromJson(now["schema"]) if now.get("schema") else None
            return {"schema": json.loads(_widened(old, arrivals.schema).json()), "shards": [*now.get("shards", []), *new]}

        return self._publish(base, content, added)

    def compact(self) -> int:
        """Runs what is due until nothing is; the version then."""
        while self.merge() is not None:
            pass
        return self.manifests.latest()

    def merge(self) -> int | None:
        """All merges and gatherings that are due, as one version; None if none is. What others merged meanwhile is planned anew."""
        base, content = self._state()
        shards = content.get("shards", [])
        groups = due_merges([s["bytes"] for s in shards], self.tiers)
        busy = {i for g in groups for i in g}
        groups += [[i] for i, s in enumerate(shards) if i not in busy and small_files(s, self.tiers)]
        if not groups:
            return None
        schema = StructType.fromJson(content["schema"])
        todo = []  # files to rewrite and files that stay
        for group in groups:
            own = [x for i in group for x in zip(shards[i]["files"], shards[i]["sizes"], shards[i]["file_rows"])]
            small = set(small_files(shards[group[0]], self.tiers)) if len(group) == 1 else {i for i, x in enumerate(own) if 2 * x[1] < self.tiers.target_bytes}
            todo.append(([x for i, x in enumerate(own) if i in small], [x for i, x in enumerate(own) if i not in small]))
        taken = [[shards[i]["id"] for i in g] for g in groups]
        folders = [f"{self.root}/data/{uuid.uuid4().hex}" if old else None for old, _ in todo]
        try:
            with ThreadPoolExecutor(self.tiers.at_once) as pool:
                list(pool.map(lambda t: self._rewrite(*t, schema), zip((old for old, _ in todo), folders)))
        except Exception:
            self._discard(folders, None)
            there = {s["id"] for s in self.shards()}
            if all(there.issuperset(ids) for ids in taken):
                raise
            return self.merge()  # another merge took the shards, and their files are gone
        listed = self._listed([f for f in folders if f])
        new = []
        for group, (old, stay), folder in zip(groups, todo, folders):
            files = [*stay, *(listed[folder] if folder else [])]
            if sum(k for _, _, k in files) != sum(shards[i]["rows"] for i in group):
                raise RuntimeError("a merge changed the number of rows")
            new.append(self._shard(files, max(shards[i]["merges"] for i in group) + (len(group) > 1)))

        def replaced(now: dict) -> dict | None:
            there = {s["id"] for s in now["shards"]}
            todo = [(ids, s) for ids, s in zip(taken, new) if there.issuperset(ids)]
            if not todo:
                return None
            # a merged shard stands where its oldest part stood
            at, gone = {ids[0]: s for ids, s in todo}, {i for ids, _ in todo for i in ids}
            return now | {"shards": [at.get(s["id"], s) for s in now["shards"] if s["id"] in at or s["id"] not in gone]}

        version = self._publish(base, content, replaced)
        self._discard(folders, version)
        return version or self.merge()

    def _discard(self, folders: list[str | None], version: int | None) -> None:
        """Deletes those of the folders that a version doesn't name."""
        named = {_folder(f) for s in self.shards(version) for f in s["files"]} if version else set()
        for folder in folders:
            if folder and folder.rsplit("/", 1)[1] not in named:
                self.manifests.delete(folder)

    def _rewrite(self, files: list[tuple[str, int, int]], folder: str | None, schema: StructType) -> None:
        """The rows of files in new ones of about the target size, a task each."""
        if files:
            rows = self.spark.read.schema(schema).parquet(*(f for f, _, _ in files))
            rows.coalesce(max(1, round(sum(n for _, n, _ in files) / self.tiers.target_bytes))).write.option("compression", "zstd").parquet(folder)

    # reads

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        version, content = self._state(version)
        if not content.get("schema"):
            raise ValueError("nothing was appended yet")
        schema = StructType.fromJson(content["schema"])
        files = [f for s in content["shards"] for f in s["files"]]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def read_placed(self, version: int | None = None, name: str = "shard") -> DataFrame:
        """The rows of a version with their shard's number in the manifest; the table of files, of bounded size for each branch, is sent to the tasks."""
        version, content = self._state(version)
        rows = self.read(version)
        if name in rows.columns:
            raise ValueError(f"there is a column {name}")
        placed = [(_key(f), i) for i, s in enumerate(content["shards"]) for f in s["files"]]
        path = [f for s in content["shards"] for f in s["files"]]
        out = None
        for a in range(0, len(path), FILES_AT_ONCE):
            own = self.spark.read.schema(rows.schema).parquet(*path[a : a + FILES_AT_ONCE])
            at = self.spark.createDataFrame(placed[a : a + FILES_AT_ONCE], f"_file string, {name} int")
            told = own.select(F.struct(*own.columns).alias("row"), F.substring_index("_metadata.file_path", "/", -2).alias("at"))
            part = told.join(F.broadcast(at), F.col("at") == F.col("_file")).select("row.*", name)
            out = part if out is None else out.unionByName(part)
        return rows.withColumn(name, F.lit(0)) if out is None else out
