"""Versioned JSON manifests, published atomically in any Hadoop file system."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer published this version first."""


class PublishUncertain(Exception):
    """The rename failed and it can't be told whether the version was published."""


class Manifests:
    """Versions 1, 2, ... of a JSON object in the folder root/_manifests. A version is written under a temporary name and
    renamed, so a reader sees all of it or nothing; a name that exists already is never replaced."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = f"{self.root}/_manifests"
        self._jvm = spark._jvm
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _name(self, version: int) -> str:
        return f"{self.folder}/v{version:012d}.json"

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def latest(self) -> int:
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> dict:
        version = version or self.latest()
        if not version:
            return {}
        stream = self._fs.open(self._path(self._name(version)))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def publish(self, version: int, content: dict) -> int:
        """Publishes exactly this version; Conflict if it exists."""
        target = self._path(self._name(version))
        if self._fs.exists(target):
            raise Conflict(f"version {version} exists")
        import uuid

        temporary = self._path(f"{self.folder}/.tmp-{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        stream.close()
        try:
            done = self._link(temporary, target) if self._fs.getUri().getScheme() == "file" else self._fs.rename(temporary, target)
        except Exception as e:
            if self._fs.exists(temporary):
                self._fs.delete(temporary, False)
                raise
            raise PublishUncertain(str(e)) from e
        if not done:
            self._fs.delete(temporary, False)
            raise Conflict(f"version {version} exists")
        return version

    def _link(self, temporary, target) -> bool:
        """A local rename would replace a target that came meanwhile; a link doesn't."""
        at = lambda p: self._jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.String, 0))
        try:
            self._jvm.java.nio.file.Files.createLink(at(target), at(temporary))
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        self._fs.delete(temporary, False)
        return True

    def create(self, path: str, content: bytes) -> bool:
        """A new file; False if there is one."""
        try:
            stream = self._fs.create(self._path(path), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        stream.write(bytearray(content))
        stream.close()
        return True

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._path(old), self._path(new))

    def published(self, version: int) -> float:
        """When a version was published, in seconds of the epoch."""
        return self._fs.getFileStatus(self._path(self._name(version))).getModificationTime() / 1000

    def drop(self, version: int) -> bool:
        return self.delete(self._name(version))

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._path(path), True)

    def files(self, path: str) -> list[tuple[str, int]]:
        """Names and bytes of the data files in a folder."""
        return sorted((s.getPath().toString(), s.getLen()) for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().startswith("part-"))

    def folders(self, path: str) -> list[tuple[str, float]]:
        """Folders within one, by name, and when they were changed last."""
        if not self._fs.exists(self._path(path)):
            return []
        return sorted((s.getPath().toString(), s.getModificationTime() / 1000) for s in self._fs.listStatus(self._path(path)) if s.isDirectory() and not s.getPath().getName().startswith("_temporary"))
