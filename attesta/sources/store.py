"""Tables in a shared folder whose states change together: files are written aside, and one small file a commit says which of them count."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer committed since this change began. Nothing of it counts."""


class Store:
    """All tables of a folder. A state is a commit file that lists each table's schema and files; readers follow the newest one, so they see
    a change wholly or not at all. A writer that stops before its commit leaves files that no state names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path, self._files = hadoop.Path, hadoop.FileContext.getFileContext(hadoop.Path(self.root).toUri(), spark._jsc.hadoopConfiguration())
        self._fs = hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/commits"))

    def version(self) -> int:
        """The number of the newest commit; 0 before the first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/commits"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def state(self, version: int | None = None) -> dict[str, dict]:
        """{table: {"schema", "files"}} as of a version, the newest if none is given."""
        version = self.version() if version is None else version
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/commits/{version:012d}.json", wholetext=True).first()[0])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.frame(self.state(version)[table])

    def frame(self, entry: dict) -> DataFrame:
        """The rows of an entry. Files of sorted keys are far smaller than their rows are in memory, and Spark would broadcast millions of them
        by the files' size; so joins with them merge, unless the other side is marked as small."""
        schema = StructType.fromJson(json.loads(entry["schema"]))
        rows = self.spark.read.schema(schema).parquet(*entry["files"]) if entry["files"] else self.spark.createDataFrame([], schema)
        return rows.hint("merge")

    def change(self) -> Change:
        return Change(self)

    def _put(self, version: int, state: dict[str, dict]) -> None:
        """Write a commit aside and give it its name, which only one writer can."""
        aside, name = self._path(f"{self.root}/commits/.{uuid.uuid4().hex}"), self._path(f"{self.root}/commits/{version:012d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        try:  # a rename without overwriting fails if another writer has the name
            self._files.rename(aside, name, self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version} of {self.root} is another writer's") from None
            raise


class Change:
    """A change of several tables, seen by itself at once and by others after commit(). It builds on the state that was the newest when it
    began; if another writer commits before it does, it fails."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.version()
        self.state = store.state(self.base)

    def read(self, table: str) -> DataFrame:
        return self.store.frame(self.state[table])

    def _stage(self, rows: DataFrame) -> list[str]:
        """The files of rows, written aside. Files without rows are left out."""
        path = f"{self.store.root}/files/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        found = self.store.spark.read.schema(rows.schema).parquet(path).select("_metadata.file_path").distinct()
        return sorted(r["file_path"] for r in found.collect())

    def replace(self, table: str, rows: DataFrame) -> None:
        """The table is these rows."""
        self.state = self.state | {table: {"schema": rows.schema.json(), "files": self._stage(rows)}}

    def append(self, table: str, rows: DataFrame) -> None:
        """These rows too."""
        if table not in self.state:
            return self.replace(table, rows)
        entry = self.state[table]
        same = rows.select(*self.store.frame(entry).columns)
        self.state = self.state | {table: entry | {"files": entry["files"] + self._stage(same)}}

    def upsert(self, table: str, rows: DataFrame, keys: list[str], update: bool = True, only: str | None = None) -> tuple[int, int]:
        """Rows by key: new keys are added, known ones replaced if `update` and, where `only` is given, if the known row meets it. Counts
        of both. Null keys are equal. Of several rows of a key, and of equal ones, the first in order of all columns counts.

        Only files that hold a replaced key are written anew, so a change costs what it touches; a change of nothing writes nothing. Rows and
        known ones meet in one join, and those of a table without rows are written at once.
        """
        if table not in self.state:
            self.replace(table, rows.limit(0))
        entry = self.state[table]
        known = self.store.frame(entry)
        columns, rest = known.columns, [c for c in known.columns if c not in keys]
        key = F.struct(*keys)  # structs with nulls in the same places are equal, and rows that are grouped by one lie right for a join by it
        first = F.min(F.struct(*rest)) if rest else F.lit(None)
        grouped = rows.select(*columns).groupBy(key.alias("_key")).agg(first.alias("_rest"))
        once = grouped.select("_key", *(F.col(f"{'_key' if c in keys else '_rest'}.{c}").alias(c) for c in columns))
        files = entry["files"]
        if not files:  # nothing to meet
            files = self._stage(once.select(*columns))
            self.state = self.state | {table: entry | {"files": files}}
            return self.read(table).count(), 0
        may = F.coalesce(F.expr(only), F.lit(False)) if only else F.lit(True)
        held = known.select(key.alias("_own"), *(F.col(c).alias(f"_was_{c}") for c in columns), F.col("_metadata.file_path").alias("_file"), may.alias("_may"))
        same = {c: F.col(c).eqNullSafe(F.col(f"_was_{c}")) for c in columns}
        takes = F.col("_file").isNull() | (F.col("_may") & ~reduce(Column.__and__, same.values()) & F.lit(update))
        met = once.join(held, F.col("_key") == F.col("_own"), "left").filter(takes).select(*columns, "_file")
        met = self.store.frame({"schema": met.schema.json(), "files": self._stage(met)})  # rows meet once; what follows sees the same ones
        new, hit = met.filter("_file is null").select(*columns), met.filter("_file is not null")
        added, changed = new.count(), hit.count()
        if changed:
            touched = {r["_file"] for r in hit.select("_file").distinct().collect()}  # as many as the table has files at most
            mine = [f for f in files if f in touched]
            old = self.store.frame(entry | {"files": mine})
            kept = old.join(hit, reduce(Column.__and__, (old[k].eqNullSafe(hit[k]) for k in keys)), "left_anti")
            files = [f for f in files if f not in touched] + self._stage(kept.unionByName(hit.select(*columns)))
        if added:
            files = files + self._stage(new)
        self.state = self.state | {table: entry | {"files": files}}
        return added, changed

    def commit(self) -> int:
        self.store._put(self.base + 1, self.state)
        return self.base + 1


def difference(store: Store, before: int, after: int) -> DataFrame:
    """table, rows_before, rows_after, added, gone: how two states of a store differ. A run that is repeated must add nothing. Tables whose
    files are the same aren't compared row by row."""
    was, now = store.state(before), store.state(after)
    found = []
    for name in sorted(set(was) | set(now)):
        a, b = (store.frame(s.get(name, {"schema": (was | now)[name]["schema"], "files": []})) for s in (was, now))
        sizes = a.agg(F.count("*").alias("rows_before")).crossJoin(b.agg(F.count("*").alias("rows_after")))  # one row each
        if was.get(name, {}).get("files") == now.get(name, {}).get("files"):
            changes = sizes.select(F.lit(name).alias("table"), "rows_before", "rows_after", F.lit(0).cast("long").alias("added"), F.lit(0).cast("long").alias("gone"))
        else:
            both = a.withColumn("_side", F.lit(-1)).unionByName(b.withColumn("_side", F.lit(1))).groupBy(*a.columns).agg(F.sum("_side").alias("n"))
            moved = both.agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("added"), F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).alias("gone"))
            changes = sizes.crossJoin(moved).select(F.lit(name).alias("table"), "rows_before", "rows_after", "added", "gone")
        found.append(changes)
    if not found:
        return store.spark.createDataFrame([], "table string, rows_before long, rows_after long, added long, gone long")
    return reduce(DataFrame.unionByName, found)
