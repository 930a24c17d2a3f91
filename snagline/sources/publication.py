"""Several tables published together.

A publication writes its tables to folders of its own version; a manifest
names them, and the last step makes it the current one.  Readers follow the
current manifest, so they see all tables of one version or of the one before; a
run that dies leaves folders that nothing names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from snagline.sources.ranges import opened

POINTER = "current.json"


class Publication:
    """The tables below a root folder, which driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files, self.base = opened(self.root)

    def manifest(self) -> dict:
        """The current version: {version, tables: {name: folder}, cursor}; version 0 has no tables."""
        path = f"{self.base}/{POINTER}"
        if self.files.get_file_info(path).type == fs.FileType.NotFound:
            return {"version": 0, "tables": {}, "cursor": None}
        with self.files.open_input_stream(path) as f:
            return json.loads(f.read())

    def read(self, name: str, manifest: dict | None = None) -> DataFrame:
        """A table of a version, the current one unless another manifest is given."""
        folder = (manifest or self.manifest())["tables"].get(name)
        if folder is None:
            raise KeyError(f"no table {name} is published")
        return self.spark.read.parquet(f"{self.root}/{folder}")

    def publish(self, tables: dict[str, DataFrame | Callable[[DataFrame | None], DataFrame]], cursor: dict | None = None) -> dict:
        """Writes tables and makes them current with the cursor, all or none; tables that are not given stay.

        A table may be a function of its current rows (None for none).  Only one
        run publishes at a time: one that finds another version than it began
        with leaves that as it is and raises.
        """
        before = self.manifest()
        folders = dict(before["tables"])
        tag = uuid.uuid4().hex
        for name, rows in tables.items():
            if callable(rows):
                rows = rows(self.read(name, before) if name in before["tables"] else None)
            folders[name] = f"{name}/v{before['version'] + 1}-{tag}"
            rows.write.parquet(f"{self.root}/{folders[name]}")
        made = {"version": before["version"] + 1, "tables": folders, "cursor": before["cursor"] if cursor is None else cursor}
        self._swap(before["version"], made, tag)
        return made

    def _swap(self, version: int, made: dict, tag: str) -> None:
        self.files.create_dir(self.base)
        draft = f"{self.base}/.{POINTER}-{tag}"
        with self.files.open_output_stream(draft) as f:
            f.write(json.dumps(made, sort_keys=True).encode())
        if self.manifest()["version"] != version:
            self.files.delete_file(draft)
            raise RuntimeError(f"version {version} is no longer the current one")
        self.files.move(draft, f"{self.base}/{POINTER}")

    def sweep(self) -> list[str]:
        """Removes folders that the current manifest does not name, and returns them; no run may be publishing."""
        named = set(self.manifest()["tables"].values())
        gone = []
        if self.files.get_file_info(self.base).type != fs.FileType.Directory:
            return gone
        for table in self.files.get_file_info(fs.FileSelector(self.base)):
            if table.type == fs.FileType.Directory:
                for version in self.files.get_file_info(fs.FileSelector(table.path)):
                    folder = f"{table.base_name}/{version.base_name}"
                    if folder not in named:
                        self.files.delete_dir(version.path)
                        gone.append(folder)
        return sorted(gone)
