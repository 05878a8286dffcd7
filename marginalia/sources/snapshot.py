"""Versioned tables under one pointer: a batch writes folders of its own for all its tables, and the pointer is swapped last.

The pointer lists, for every table, its schema and the folders that make it up. Readers see all tables before or after a
batch, never a mixture, and columns keep their stored types. The batch that the pointer names is not applied again, so a
repeated micro-batch changes nothing; one that failed half-way left only folders no pointer names, which it overwrites.
One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, types as T

#: Folders of a table from which an appending batch rewrites them into one.
FOLDERS = 32


class SnapshotStore:
    """Tables below ``root``; rows of a folder are sorted by ``group_id`` where there is one, so that a journal is found by its statistics."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        # The pointer is replaced in one rename, so there is no moment without one.
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._overwrite = spark.sparkContext._gateway.new_array(rename, 1)
        self._overwrite[0] = rename.OVERWRITE

    def _current(self) -> dict:
        pointer = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(pointer):
            return {"batch": None, "tables": {}}
        stream = self._fs.open(pointer)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def batch(self) -> str | None:
        """The batch applied last, or none."""
        return self._current()["batch"]

    def version(self, name: str) -> str | None:
        """The newest folder of a table, or none."""
        entry = self._current()["tables"].get(name)
        return entry["folders"][-1] if entry else None

    def read(self, name: str) -> DataFrame:
        entry = self._current()["tables"].get(name)
        if entry is None:
            raise LookupError(f"there is no table {name}")
        return self._read(name, entry)

    def _read(self, name: str, entry: dict) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{f}" for f in entry["folders"]])

    def commit(self, batch: str, whole: dict[str, DataFrame] | None = None, more: dict[str, DataFrame] | None = None) -> bool:
        """Apply a batch: tables in ``whole`` are replaced, rows in ``more`` are added. False where it was applied before.

        New columns of added rows come last; rows that lack a column have null there.
        """
        current = self._current()
        if current["batch"] == batch:
            return False
        tables = dict(current["tables"])
        for name, df in (whole or {}).items():
            tables[name] = {"schema": self._put(name, df, batch), "folders": [f"b-{batch}"]}
        for name, df in (more or {}).items():
            old = tables.get(name)
            if old and len(old["folders"]) >= FOLDERS:
                df, old = self._read(name, old).unionByName(df, allowMissingColumns=True), None
            schema = self._put(name, df, batch)
            known = old["schema"]["fields"] if old else []
            fields = known + [f for f in schema["fields"] if f["name"] not in {k["name"] for k in known}]
            tables[name] = {"schema": {"type": "struct", "fields": fields}, "folders": [*(old["folders"] if old else []), f"b-{batch}"]}
        fresh = self._path(f"{self.root}/CURRENT.{batch}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps({"batch": batch, "tables": tables}).encode()))
        out.close()
        self._context.rename(fresh, self._path(f"{self.root}/CURRENT"), self._overwrite)
        return True

    def _put(self, name: str, df: DataFrame, batch: str) -> dict:
        rows = df.sortWithinPartitions("group_id") if "group_id" in df.columns else df
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/b-{batch}")
        fields = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields]
        return json.loads(T.StructType(fields).json())

    def write(self, name: str, df: DataFrame, batch: str) -> bool:
        """Replace one table by ``df`` in a batch of its own."""
        return self.commit(batch, whole={name: df})

    def reset(self, seeds: dict[str, DataFrame], batch: str) -> bool:
        """Everything away but the seed rows of the given tables; other tables become empty."""
        empty = {n: self.read(n).limit(0) for n in self._current()["tables"] if n not in seeds}
        return self.commit(batch, whole={**empty, **seeds})

    def missing(self, rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
        """The ``rows`` whose keys the table does not have; all of them where there is no table."""
        if self.version(name) is None:
            return rows
        return rows.join(self.read(name).select(*keys), keys, "left_anti")
