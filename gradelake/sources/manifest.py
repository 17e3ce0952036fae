"""Tables of parts with a manifest: what the newest manifest names is the table, and nothing else.

A part is a folder of Parquet files, written first; then the next manifest, which lists the parts, is put in place by one rename.
A run that breaks off leaves a part that no manifest names, so it is never seen. Where the file system refuses to rename onto a file that
exists, as HDFS does, two writers that publish at once do not lose each other's parts: the later one adds its part to the newer manifest. On a file system
that replaces files, such as a local one, only one driver may write a table at a time. Readers open one small file, however many runs there were;
``compact`` makes one part of many.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradelake.operators.keyed import last_wins

ATTEMPTS = 20


class PartTable:
    """A table under ``path`` in a folder that driver and executors share. Only the driver reads and writes manifests."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """Number of the newest manifest; 0 where there is none."""
        folder = self._path("manifests")
        if not self._files.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def parts(self, version: int | None = None) -> list[dict]:
        """The parts of a version, the oldest first: name, schema (JSON) and run number."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._files.open(self._path(f"manifests/{version:09d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, change: Callable[[list[dict]], list[dict]]) -> int:
        for _ in range(ATTEMPTS):
            version = self.version()
            draft, final = self._path(f"manifests/draft-{uuid.uuid4().hex}"), self._path(f"manifests/{version + 1:09d}.json")
            out = self._files.create(draft, False)
            try:
                out.write(bytearray(json.dumps(change(self.parts(version))).encode()))
            finally:
                out.close()
            if not self._files.exists(final) and self._files.rename(draft, final):
                return version + 1
            self._files.delete(draft, False)
        raise RuntimeError(f"no manifest could be published under {self.path}")

    def add(self, rows: DataFrame) -> int:
        """Write ``rows`` as a part and publish it; returns the version that has it."""
        name = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/parts/{name}")
        return self._publish(lambda old: [*old, {"name": name, "schema": rows.schema.json(), "run": max((p["run"] for p in old), default=0) + 1}])

    def _one(self, part: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(part["schema"]))).parquet(f"{self.path}/parts/{part['name']}")

    def read(self, defaults: dict[str, object] | None = None, fill: bool = True, run: str | None = None) -> DataFrame | None:
        """All rows of the newest manifest's parts as one table, whatever columns each part had; None where nothing was published.

        Parts of one schema are read together, so the plan has a branch per schema and not per part. A column that a part lacks has its value of
        ``defaults`` there, else null; with ``fill`` nulls of parts that have the column are filled too, as an added column with a default does.
        ``run`` names a column for the number of the run that wrote the row.
        """
        return self._read(self.parts(), defaults or {}, fill, run)

    def _read(self, parts: list[dict], defaults: dict[str, object], fill: bool, run: str | None) -> DataFrame | None:
        if not parts:
            return None
        by: dict[str, list[dict]] = {}
        for p in parts:
            by.setdefault(p["schema"], []).append(p)
        frames = []
        for schema, group in by.items():
            kind = StructType.fromJson(json.loads(schema))
            df = self.spark.read.schema(kind).parquet(*[f"{self.path}/parts/{p['name']}" for p in group])
            if run:
                name = F.regexp_extract(F.col("_metadata.file_path"), r"/(part-[0-9a-f]{32})/", 1)
                runs = F.create_map(*[F.lit(x) for p in group for x in (p["name"], p["run"])])
                df = df.select("*", F.element_at(runs, name).alias(run))
            lacking = {c: F.lit(v) for c, v in defaults.items() if c not in kind.fieldNames()}
            held = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if fill and c in kind.fieldNames()}
            frames.append(df.withColumns({**held, **lacking}))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def compact(self, keys: list[str] | None = None, defaults: dict[str, object] | None = None) -> int:
        """One part in place of those of now; with ``keys`` only the row of the last run of each key. Parts that others add meanwhile stay.

        The row that stays for a key has its own values throughout; rows of one key and run are told apart by all their columns.
        """
        old = self.parts()
        if len(old) < 2:
            return self.version()
        rows = self._read(old, defaults or {}, True, "_run")
        if keys:
            rest = [c for c in rows.columns if c not in (*keys, "_run")]
            rows = last_wins(rows.withColumn("_order", F.struct("_run", F.xxhash64(*rest))), keys, "_order").drop("_order")
        rows = rows.drop("_run")
        name, gone = f"part-{uuid.uuid4().hex}", {p["name"] for p in old}
        rows.write.parquet(f"{self.path}/parts/{name}")
        one = {"name": name, "schema": rows.schema.json(), "run": max(p["run"] for p in old)}
        return self._publish(lambda now: [one, *[p for p in now if p["name"] not in gone]])


def cached(source: DataFrame, table: PartTable, fn: Callable[[DataFrame], DataFrame], key: str = "cache_key") -> DataFrame:
    """``fn``'s rows for the keys of ``source``: those the table has, and the others computed once and added to it.

    Only keys that no part holds go to ``fn``, one source row each; their results are published before anything is returned, so the next call
    finds them. Null keys are left out. ``fn`` returns ``key`` and any columns; a key without rows is computed again next time.
    """
    keys = source.select(key).dropna().distinct()
    held = table.read()
    todo = source.dropna(subset=[key]).dropDuplicates([key])
    if held is not None:
        todo = todo.join(held.select(key).distinct(), key, "left_anti")
    if not todo.isEmpty():
        table.add(fn(todo))
    return table.read().join(keys, key, "left_semi") if table.version() else fn(todo)


def run_parts(table: PartTable, work: DataFrame, fn: Callable[[DataFrame], DataFrame], required: list[str], key: str = "doc_id") -> DataFrame:
    """Run a stage for open documents only: those without a row in which all ``required`` columns are there. Each document shows its last complete
    run, or its last one if none is complete. The next run reads one manifest, and after ``compact`` one part."""
    def shown() -> DataFrame | None:
        rows = table.read(run="_run")
        if rows is None or any(c not in rows.columns for c in required):
            return rows
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required], F.lit(True))
        each = rows.groupBy(key, "_run").agg(F.bool_and(whole).alias("_whole"))
        last = each.groupBy(key).agg(F.max(F.struct("_whole", "_run")).alias("_last")).select(key, F.col("_last._whole").alias("_whole"), F.col("_last._run").alias("_run"))
        return rows.join(last, [key, "_run"])

    done = shown()
    complete = done.filter("_whole").select(key).distinct() if done is not None and "_whole" in done.columns else None
    todo = work if complete is None else work.join(complete, key, "left_anti")
    if complete is None or not todo.isEmpty():
        table.add(fn(todo))
    return shown().drop("_run", "_whole")
