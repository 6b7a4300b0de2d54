"""Versioned state of a stored operator: small JSON files beside its data.

``versions/00000007.json`` names the data folders and counters of version 7.
Data folders are written first and are never changed; a version that names them
is committed after, so a job that fails in between leaves the last version as it
was.  There is one writer (the query that owns the store) and any number of readers;
a reader keeps its version until ``drop`` removes it.  The state must stay small: it
holds folder names and counters, never rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _names(self, folder: str) -> list[str]:
        files, place = self._files(f"{self.path}/{folder}")
        if not files.exists(place):
            return []
        return sorted(s.getPath().getName() for s in files.listStatus(place))

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[0].isdigit()]

    def read(self, version: int | None = None) -> dict | None:
        """The state of ``version`` (the last one if None); None before the first commit."""
        have = self.versions()
        if not have:
            return None
        version = have[-1] if version is None else version
        files, place = self._files(f"{self.path}/versions/{version:08d}.json")
        stream = files.open(place)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"version": version}

    def commit(self, state: dict) -> int:
        """Write ``state`` as the version after the last one.  The file gets its
        name only when it is complete."""
        have = self.versions()
        version = have[-1] + 1 if have else 0
        files, part = self._files(f"{self.path}/versions/.{version}-{uuid.uuid4().hex}")
        out = files.create(part, False)
        out.write(bytearray(json.dumps({k: v for k, v in state.items() if k != "version"}).encode()))
        out.close()
        _, final = self._files(f"{self.path}/versions/{version:08d}.json")
        if files.exists(final) or not files.rename(part, final):
            files.delete(part, False)
            raise RuntimeError(f"version {version} of {self.path} was written by someone else")
        return version

    def folder(self, name: str) -> str:
        """A new data folder (not yet part of any version)."""
        return f"{self.path}/data/{name}-{uuid.uuid4().hex[:12]}"

    def discard(self, folder: str) -> None:
        """Delete a data folder that no version names."""
        files, place = self._files(folder)
        files.delete(place, True)

    def drop(self, keep: int, named_by) -> int:
        """Delete all but the last ``keep`` versions, and the data folders that no
        remaining version names (``named_by``: state -> folders).  Returns how many
        folders went."""
        have = self.versions()
        kept = have[len(have) - keep:] if keep else []
        for version in have:
            if version not in kept:
                files, place = self._files(f"{self.path}/versions/{version:08d}.json")
                files.delete(place, False)
        named = {f.rsplit("/", 1)[-1] for v in kept for f in named_by(self.read(v))}
        gone = [n for n in self._names("data") if n not in named]
        for name in gone:
            files, place = self._files(f"{self.path}/data/{name}")
            files.delete(place, True)
        return len(gone)
