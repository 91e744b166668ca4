"""Tables of a store in the order of their pages, newest first: a page reads the few files that follow a cursor."""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lintlake.sources.store import BUCKET, Store

#: Rows of a part; the manifest has one entry for each part.
PART_ROWS = 1_000_000


class PagedTable:
    """A table in falling order of a time and an id (nulls last), in parts that do not overlap, each a folder of its own.

    A cursor is [time, id] of a page's last row, with timestamps as microseconds and dates as days. The manifest knows the last row of each
    part, so any page starts at the part that its cursor falls into; where a filter leaves too few rows there, it reads on in runs of parts
    twice as long each. Rows that agree in time and id come on one page, which may hold more than ``limit`` rows then.
    """

    def __init__(self, store: Store, name: str, time: str, id: str):
        self.store, self.name, self.order = store, name, [time, id]

    def _key(self, schema: T.StructType) -> Column:
        def plain(name: str) -> Column:
            kind = schema[name].dataType
            if isinstance(kind, T.TimestampType):
                return F.unix_micros(name)
            return F.unix_date(name) if isinstance(kind, T.DateType) else F.col(name)

        return F.struct(plain(self.order[0]).alias("time"), plain(self.order[1]).alias("id"))

    def write(self, rows: DataFrame, part_rows: int = PART_ROWS) -> None:
        """Replace the table."""
        parts, order = max(1, -(-rows.count() // part_rows)), [F.col(c).desc_nulls_last() for c in self.order]
        ranged = rows.repartitionByRange(parts, *order).withColumn(BUCKET, F.spark_partition_id()).sortWithinPartitions(BUCKET, *order)
        version = uuid.uuid4().hex
        ranged.write.partitionBy(BUCKET).parquet(f"{self.store.path}/data/{version}")
        shape = T.StructType([*rows.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        stored = self.store._read([version], json.loads(shape.json()))
        lasts = stored.groupBy(BUCKET).agg(F.min(self._key(rows.schema)).alias("k"), F.count("*").alias("rows")).orderBy(BUCKET).collect()  # one row a part
        found = {str(n): {"folder": f"{version}/{BUCKET}={r[BUCKET]}", "rows": r["rows"], "last": list(r["k"])} for n, r in enumerate(lasts)}
        entry = {"parts": found, "schema": json.loads(rows.schema.json()), "order": self.order}
        self.store.change(lambda tables: {**tables, self.name: entry})

    def page(self, limit: int, after: list | None = None, where: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, list | None]:
        """The first ``limit`` rows that ``where`` leaves behind the cursor, in order, and the next page's cursor (None: no row was left).

        ``where`` only filters. A cursor stays good when the table is written anew: it is a place in the order, not in the files.
        """
        entry = self.store.current()[1][self.name]
        schema, parts = T.StructType.fromJson(entry["schema"]), list(entry["parts"].values())
        key = self._key(schema)
        shape = self.store.spark.createDataFrame([], schema).select(key.alias("k")).schema["k"].dataType

        def place(cursor: list) -> Column:
            return F.struct(*[F.lit(value).cast(f.dataType).alias(f.name) for value, f in zip(cursor, shape.fields, strict=True)])

        def rows(first: int, end: int) -> DataFrame:
            stored = self.store._read([p["folder"] for p in parts[first:end]], entry["schema"])
            return where(stored if after is None else stored.filter(key < place(after)))

        start = 0 if after is None else bisect_left(parts, True, key=lambda part: _rank(part["last"]) < _rank(after))
        end, run, keys = start, 1, []
        while end < len(parts) and len(keys) < limit:
            following = min(end + run, len(parts))
            keys += [list(r["k"]) for r in rows(end, following).select(key.alias("k")).orderBy(F.desc("k")).limit(limit - len(keys)).collect()]
            end, run = following, run * 2
        if not keys:
            return rows(0, 0), None
        order = [F.col(c).desc_nulls_last() for c in self.order]
        return rows(start, end).filter(key >= place(keys[-1])).orderBy(*order), keys[-1]


def _rank(cursor: list) -> list[tuple]:
    """Comparable as the rows are: null below all values."""
    return [(value is not None, value) for value in cursor]
