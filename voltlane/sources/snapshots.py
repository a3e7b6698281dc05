"""Published tables: written beside each other, switched all at once.

Every publication writes new folders and then one small manifest that names, for every part of every table, the folder
that counts. A manifest is put in place by a rename that fails if another writer was there first. Readers resolve the
newest manifest, so they see a publication whole or not at all, and what they have resolved stays readable while newer
ones are written. Parts that a publication does not name keep their folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hadoop_folder, make_folder


class ConcurrentPublication(RuntimeError):
    """Another writer published between the start and the end of a publication."""


class Split(NamedTuple):
    """Rows of several parts; a part is named by the values of ``by``, joined by dashes. ``parts`` are replaced even if they have no rows."""

    rows: DataFrame
    by: Sequence[str]
    parts: Sequence[str] = ()


class Snapshots:
    """Tables under one root, in parts such as one per KPI family."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- manifests ------------------------------------------------------------------------------
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        files, at = hadoop_folder(self.spark, f"{self.root}/manifests")
        if not files.exists(at):
            return []
        names = [f.getPath().getName() for f in files.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """``{"version": n, "tables": {table: {part: {"folder": ..., "schema": ...}}}}``; empty before the first publication."""
        known = self.versions()
        if not known:
            return {"version": 0, "tables": {}}
        version = known[-1] if version is None else version
        text = self.spark.read.text(f"{self.root}/manifests/{version:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _put(self, manifest: dict) -> None:
        jvm = self.spark._jvm
        make_folder(self.spark, f"{self.root}/manifests")
        files, draft = hadoop_folder(self.spark, f"{self.root}/manifests/_draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path(f"manifests/{manifest['version']:08d}.json"), none)
        except Exception as e:
            files.delete(draft, False)
            raise ConcurrentPublication(f"version {manifest['version']} of {self.root} was published by another writer") from e

    # ---- writing ----------------------------------------------------------------------------------
    def publish(self, parts: Mapping[str, Mapping[str, DataFrame] | Split], keep: int = 2) -> int:
        """Write ``{table: {part: rows}}``, or ``{table: Split}`` in one job, switch to it, and return the new version.

        A part without rows is published as empty. Folders and manifests that none of the last ``keep`` versions
        names are deleted after the switch.
        """
        now = self.manifest()
        tables = {t: dict(p) for t, p in now["tables"].items()}
        run = uuid.uuid4().hex
        for table, named in parts.items():
            known = tables.setdefault(table, {})
            folder = f"data/{table}/{run}"
            if isinstance(named, Split):
                name = F.concat_ws("-", *named.by)
                named.rows.withColumn("part", name).write.partitionBy("part").parquet(f"{self.root}/{folder}")
                files, at = hadoop_folder(self.spark, f"{self.root}/{folder}")
                written = {f.getPath().getName().removeprefix("part=") for f in files.listStatus(at) if f.isDirectory()}
                for part in written | set(named.parts):
                    known[part] = {"folder": f"{folder}/part={part}" if part in written else None, "schema": named.rows.schema.json()}
            else:
                for part, rows in named.items():
                    rows.write.parquet(f"{self.root}/{folder}/part={part}")
                    known[part] = {"folder": f"{folder}/part={part}", "schema": rows.schema.json()}
        self._put({"version": now["version"] + 1, "tables": tables})
        self._expire(keep)
        return now["version"] + 1

    def _expire(self, keep: int) -> None:
        versions = self.versions()
        folders = lambda v: {p["folder"] for t in self.manifest(v)["tables"].values() for p in t.values() if p["folder"]}
        kept = set().union(*[folders(v) for v in versions[-keep:]])
        for version in versions[:-keep]:
            for folder in folders(version) - kept:
                files, at = hadoop_folder(self.spark, f"{self.root}/{folder}")
                files.delete(at, True)
            files, at = hadoop_folder(self.spark, f"{self.root}/manifests/{version:08d}.json")
            files.delete(at, False)

    # ---- reading ----------------------------------------------------------------------------------
    def read(self, table: str, parts: Iterable[str] | None = None, version: int | None = None) -> DataFrame | None:
        """Rows of a table (or of some of its parts) in the newest version, or in a given one; None if it was never published."""
        known = self.manifest(version)["tables"].get(table, {})
        wanted = [known[p] for p in (known if parts is None else parts) if p in known]
        if not wanted:
            return None
        schema = T.StructType.fromJson(json.loads(wanted[-1]["schema"]))
        folders = [f"{self.root}/{p['folder']}" for p in wanted if p["folder"]]
        # the name of a part is no column
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
