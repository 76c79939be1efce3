"""A versioned store of tables: a commit writes new tables and then one manifest that names all of them.

Readers see the tables of one manifest, so vectors and metadata never disagree, and a failed commit leaves the version
before in place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    @property
    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"there is no index at {self.path}")
        stream = self._fs.open(self._path(f"{self.path}/manifest-{version or found[-1]:09d}.json"))
        try:
            return json.loads(bytes(self._bytes(stream)).decode())
        finally:
            stream.close()

    def _bytes(self, stream) -> bytes:
        return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table of the version; parts of one schema are read at once, whatever their number."""
        manifest = self.manifest(version)
        if name not in manifest["tables"]:
            raise FileNotFoundError(f"there is no table {name} at {self.path}")
        groups: dict[str, list[str]] = {}
        for part in manifest["tables"][name]:
            groups.setdefault(manifest["schemas"][part], []).append(f"{self.path}/{part}")
        out = None
        for schema, paths in groups.items():
            read = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*paths)
            out = read if out is None else out.unionByName(read, allowMissingColumns=True)
        return out

    def parts(self, name: str) -> int:
        """The number of written parts of a table; 0 if there is none."""
        return len(self.manifest()["tables"].get(name, [])) if self.exists else 0

    def has(self, name: str) -> bool:
        return self.exists and name in self.manifest()["tables"]

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, drop: tuple[str, ...] = (), facts: dict | None = None) -> int:
        """Write tables and a manifest; tables that aren't named stay as they are. Returns the version."""
        before = self.manifest() if self.exists else {"tables": {}, "facts": {}, "schemas": {}}
        schemas = dict(before["schemas"])
        tables = {k: list(v) for k, v in before["tables"].items() if k not in drop}
        for how, frames in (("replace", replace or {}), ("append", append or {})):
            for name, df in frames.items():
                part = f"{name}-{uuid.uuid4().hex}"
                df.write.parquet(f"{self.path}/{part}")
                schemas[part] = df.schema.json()
                tables[name] = [part] if how == "replace" else [*tables.get(name, []), part]
        version = (self.versions() or [0])[-1] + 1
        named = {part for parts in tables.values() for part in parts}
        body = json.dumps({"version": version, "tables": tables, "schemas": {k: v for k, v in schemas.items() if k in named}, "facts": before["facts"] | (facts or {})})
        place = self._path(f"{self.path}/manifest-{version:09d}.json")
        self._fs.mkdirs(self._path(self.path))
        try:
            out = self._fs.create(place, False)  # fails if another commit has written this version
        except Exception as e:
            raise RuntimeError("another commit came first") from e
        out.write(body.encode())
        out.close()
        return version

    def clean(self, keep: int = 1) -> None:
        """Delete manifests but the last ``keep``, and tables that none of these names."""
        found = self.versions()
        named = {p for v in found[-keep:] for parts in self.manifest(v)["tables"].values() for p in parts}
        for v in found[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifest-{v:09d}.json"), False)
        for s in self._fs.listStatus(self._path(self.path)):
            if s.isDirectory() and s.getPath().getName() not in named:
                self._fs.delete(s.getPath(), True)
