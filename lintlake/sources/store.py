"""A folder of named tables whose every change is one new manifest: snapshots, and keyed tables that are changed bucket by bucket.

``<path>/data/<version>/`` holds Parquet files that are never changed; ``<path>/manifest/<number>.json`` says which of them are the tables
now (name, folders, schema, row counts). A change writes its data first and then renames one manifest into place, which fails if another
writer was faster (the change is then made anew on what that one left). So a reader sees the tables before or after a change, a job killed
midway changes nothing, and names are any text. ``vacuum`` deletes data that no kept manifest mentions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKET = "_bucket"


class Conflict(Exception):
    """Another writer has put the next manifest."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)

    # --- manifests ------------------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def _manifest(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{number:012d}.json", wholetext=True).first()[0])

    def current(self) -> tuple[int, dict]:
        """Number and tables of the newest manifest; 0 and none of a new store."""
        numbers = self._numbers()
        return (numbers[-1], self._manifest(numbers[-1])) if numbers else (0, {})

    def _put(self, number: int, tables: dict) -> None:
        made = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        try:
            out.write(json.dumps(tables).encode())
        finally:
            out.close()
        gateway = self.spark.sparkContext._gateway
        never = gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._files.rename(made, self._path(f"{self.path}/manifest/{number:012d}.json"), never)
        except Py4JJavaError as error:
            self._fs.delete(made, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"manifest {number} of {self.path}") from error
            raise

    def change(self, make: Callable[[dict], dict | None], tries: int = 5) -> bool:
        """Put what ``make`` makes of the current tables (None: no change) as the next manifest; again if another writer was faster."""
        for left in reversed(range(tries)):
            number, tables = self.current()
            after = make(dict(tables))
            if after is None:
                return False
            try:
                self._put(number + 1, after)
                return True
            except Conflict:
                if not left:
                    raise
        return False

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests but the newest ``keep`` and the data that only older ones mention; the number of folders deleted.

        Not to be run beside a writer, whose data no manifest mentions yet.
        """
        numbers = self._numbers()
        used = {folder.split("/")[0] for n in numbers[-keep:] for entry in self._manifest(n).values() for folder in _folders(entry)}
        data, gone = self._path(f"{self.path}/data"), 0
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if status.getPath().getName() not in used:
                gone += self._fs.delete(status.getPath(), True)
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifest/{n:012d}.json"), False)
        return gone

    # --- data -----------------------------------------------------------------------------------

    def _write(self, df: DataFrame, buckets: bool) -> str:
        version = uuid.uuid4().hex
        # rebalanced by bucket: whole files, and a large bucket in several of them
        writer = df.hint("rebalance", BUCKET).write.partitionBy(BUCKET) if buckets else df.write
        writer.parquet(f"{self.path}/data/{version}")
        return version

    def _read(self, folders: Sequence[str], schema: dict) -> DataFrame:
        shape = T.StructType.fromJson(schema)
        if not folders:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(*[f"{self.path}/data/{f}" for f in folders])

    # --- named snapshots ------------------------------------------------------------------------

    def save(self, name: str, df: DataFrame) -> None:
        """Replace the table of a name, by rows or by none."""
        version = self._write(df, False)
        schema = json.loads(df.schema.json())
        entry = {"folder": version, "schema": schema, "rows": self._read([version], schema).count()}
        self.change(lambda tables: {**tables, name: entry})

    def read(self, name: str) -> DataFrame | None:
        entry = self.current()[1].get(name)
        return None if entry is None else self._read(_folders(entry), entry["schema"])

    def delete(self, name: str) -> bool:
        return self.change(lambda tables: None if name not in tables else {k: v for k, v in tables.items() if k != name})

    def rows(self) -> dict[str, int]:
        """Row counts by name."""
        return {name: _rows(entry) for name, entry in self.current()[1].items()}

    def read_all(self, name_column: str) -> DataFrame:
        """All tables in one scan, with their names; columns as in the first of them."""
        tables = self.current()[1]
        if not tables:
            return self.spark.createDataFrame([], f"`{name_column}` string")
        names = self.spark.createDataFrame([(n, f.split("/")[0]) for n, e in tables.items() for f in _folders(e)], f"`{name_column}` string, _version string").distinct()
        rows = self._read([f for e in tables.values() for f in _folders(e)], next(iter(tables.values()))["schema"])
        version = F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]{32})/", 1)
        return rows.withColumn("_version", version).join(names, "_version").drop("_version")


def _folders(entry: dict) -> list[str]:
    return [entry["folder"]] if "folder" in entry else [part["folder"] for part in entry["parts"].values()]


def _rows(entry: dict) -> int:
    return entry["rows"] if "rows" in entry else sum(part["rows"] for part in entry["parts"].values())


class KeyedTable:
    """A table of a store in ``buckets`` by a hash of ``by`` (a SQL expression over its columns); changes rewrite the buckets they touch.

    Rows that a change looks at together must have equal ``by``. Changes that carry a number are made once: a ``batch`` not above the last
    one is a replay and changes nothing.
    """

    def __init__(self, store: Store, name: str, by: str, buckets: int = 64):
        self.store, self.name, self.by, self.buckets = store, name, by, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.expr(self.by)), F.lit(self.buckets)).cast("int")

    def _entry(self, tables: dict) -> dict:
        found = tables.get(self.name)
        if found is not None and (found["by"], found["buckets"]) != (self.by, self.buckets):
            raise ValueError(f"{self.name} is stored in {found['buckets']} buckets by {found['by']}")
        return dict(found) if found else {"parts": {}, "by": self.by, "buckets": self.buckets, "batch": None, "schema": None}

    def read(self) -> DataFrame:
        """All rows; a table that was never written has no schema and is an error."""
        return self._of(self._entry(self.store.current()[1]), None)

    def _of(self, entry: dict, buckets: set[int] | None) -> DataFrame:
        return self.store._read([p["folder"] for k, p in entry["parts"].items() if buckets is None or int(k) in buckets], entry["schema"])

    def _parts(self, df: DataFrame) -> dict:
        """Write rows and give their buckets."""
        version = self.store._write(df.withColumn(BUCKET, self._bucket()), True)
        shape = T.StructType([*df.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        counts = self.store._read([version], json.loads(shape.json())).groupBy(BUCKET).count().collect()  # one row a bucket
        return {str(r[BUCKET]): {"folder": f"{version}/{BUCKET}={r[BUCKET]}", "rows": r["count"]} for r in counts}

    def merge(self, rows: DataFrame, resolve: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> bool:
        """Put ``resolve(stored, rows)`` in place of the stored rows of the buckets that ``rows`` falls into."""
        def make(tables: dict) -> dict | None:
            entry = self._entry(tables)
            if batch is not None and entry["batch"] is not None and batch <= entry["batch"]:
                return None
            entry["schema"] = entry["schema"] or json.loads(rows.schema.json())
            touched = {r[0] for r in rows.select(self._bucket()).distinct().collect()}  # at most one row a bucket
            return self._replaced(tables, entry, touched, resolve(self._of(entry, touched), rows), batch)

        return self.store.change(make)

    def remove(self, gone: Column, batch: int | None = None) -> bool:
        """Delete the rows for which ``gone`` is true; buckets without such a row stay as they are."""
        def make(tables: dict) -> dict | None:
            entry = self._entry(tables)
            if entry["schema"] is None or batch is not None and entry["batch"] is not None and batch <= entry["batch"]:
                return None
            touched = {r[0] for r in self._of(entry, None).filter(gone).select(self._bucket()).distinct().collect()}
            if not touched:
                return None
            left = self._of(entry, touched).filter(~F.coalesce(gone, F.lit(False)))
            return self._replaced(tables, entry, touched, left, batch)

        return self.store.change(make)

    def _replaced(self, tables: dict, entry: dict, touched: set[int], rows: DataFrame, batch: int | None) -> dict:
        parts = {k: p for k, p in entry["parts"].items() if int(k) not in touched}
        names = [f["name"] for f in entry["schema"]["fields"]]
        parts.update(self._parts(rows.select(*names)) if touched else {})
        return {**tables, self.name: {**entry, "parts": parts, "batch": entry["batch"] if batch is None else batch}}
