"""A table by key on plain files that changes without being rewritten.

Rows are dealt to buckets by a hash of their key and written as one folder of Parquet files per bucket. A change writes a
segment of its own with the new rows and delete markers of the keys it touches, in the buckets it touches; files of other
buckets stay. A version of the table is a manifest: its segments in order, each with the buckets it still holds. It is
published by one rename, so readers see a change whole or not at all, and a version that a reader has begun stays readable
until ``vacuum`` drops it.

Reading merges: buckets without change segments are read as they are; in the others, rows whose key a change names are left
out and the last change of each key comes in their place. That is one aggregate over the changes and one join of theirs keys
with the rows of the touched buckets, where the changes are the small side. ``compact`` writes buckets of many change
segments anew.

NULL keys are equal. A change that repeats, by its ``source`` and ``batch``, is left out, so a restarted stream counts once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import match_on, names
from tallyloom.sources import manifests

_BUCKET, _GONE, _AT = "__bucket", "__gone", "__at"


class KeyedTable:
    """One version of a table below ``path``; ``apply`` and ``compact`` return the next."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict) -> None:
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest

    # ------------------------------------------------------------ versions

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys, buckets: int = 64) -> KeyedTable:
        """A new table; keys must be unique. ``buckets`` should keep a bucket's rows within what a task can rewrite."""
        spark = rows.sparkSession
        table = cls(spark, path, {
            "version": -1, "keys": names(keys), "buckets": buckets, "schema": rows.schema.json(), "batches": {}, "segments": [],
        })
        return table._publish([table._segment(rows.withColumn(_GONE, F.lit(False)), "rows")])

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> KeyedTable:
        folder = f"{path.rstrip('/')}/manifests"
        text = manifests.newest(spark, folder)[1] if version is None else manifests.record(spark, folder, version)
        return cls(spark, path, json.loads(text))

    @property
    def version(self) -> int:
        return self.manifest["version"]

    @property
    def keys(self) -> list[str]:
        return self.manifest["keys"]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.manifest["schema"]))

    def last_batch(self, source: str) -> int | None:
        """The last batch of a source that this version holds."""
        return self.manifest["batches"].get(source)

    def before_batch(self, source: str, batch: int) -> KeyedTable:
        """The newest version that holds no batch of the source from ``batch`` on."""
        table = self
        while (last := table.last_batch(source)) is not None and last >= batch:
            table = KeyedTable.load(self.spark, self.path, table.version - 1)
        return table

    def _publish(self, segments: list[dict], source: str | None = None, batch: int | None = None) -> KeyedTable:
        manifest = dict(self.manifest, version=self.version + 1, segments=[s for s in segments if s["buckets"]])
        if source is not None:
            manifest["batches"] = dict(manifest["batches"], **{source: batch})
        manifests.publish(self.spark, f"{self.path}/manifests", manifest["version"], json.dumps(manifest))
        return KeyedTable(self.spark, self.path, manifest)

    # ------------------------------------------------------------ files

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.manifest["buckets"])).cast("int")

    def _segment(self, rows: DataFrame, kind: str) -> dict:
        """Rows with delete marks as a new segment; its buckets are those that got files."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.withColumn(_BUCKET, self._bucket()).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(folder)
        got = [n.partition("=")[2] for n in manifests.listing(self.spark, folder) if n.startswith(f"{_BUCKET}=")]
        return {"path": folder, "kind": kind, "buckets": sorted(map(int, got))}

    def _read(self, segment: dict, buckets: set[int] | None = None) -> DataFrame | None:
        """A segment's rows in some of its buckets; other buckets aren't listed by the scan."""
        held = sorted(set(segment["buckets"]) & buckets) if buckets is not None else segment["buckets"]
        if not held:
            return None
        schema = T.StructType([*self.schema, T.StructField(_GONE, T.BooleanType()), T.StructField(_BUCKET, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(segment["path"]).filter(F.col(_BUCKET).isin(held))

    def _segments(self, kind: str) -> list[dict]:
        return [s for s in self.manifest["segments"] if s["kind"] == kind]

    def changed_buckets(self) -> set[int]:
        return {b for s in self._segments("changes") for b in s["buckets"]}

    # ------------------------------------------------------------ reading

    def _union(self, parts) -> DataFrame:
        columns = [f.name for f in self.schema]
        found = [p.select(*columns) for p in parts if p is not None]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], self.schema)

    def last_changes(self, buckets: set[int] | None = None) -> DataFrame | None:
        """The last change of each key that any change names, with its delete mark."""
        parts = []
        for number, segment in enumerate(self.manifest["segments"]):
            if segment["kind"] == "changes" and (part := self._read(segment, buckets)) is not None:
                parts.append(part.withColumn(_AT, F.lit(number)))
        if not parts:
            return None
        columns = [*(f.name for f in self.schema), _GONE]
        return (
            reduce(DataFrame.unionByName, parts).groupBy(*self.keys).agg(F.max_by(F.struct(*columns), _AT).alias("__c")).select("__c.*")
        )

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """The table's rows, or those of some buckets."""
        changed = self.changed_buckets() if buckets is None else self.changed_buckets() & buckets
        every = set(range(self.manifest["buckets"])) if buckets is None else buckets
        plain = [self._read(s, every - changed) for s in self._segments("rows")]
        last = self.last_changes(changed) if changed else None
        if last is None:
            return self._union(plain)
        before = self._union(self._read(s, changed) for s in self._segments("rows"))
        named = last.select(*[F.col(k).alias(f"__k_{k}") for k in self.keys])
        stays = before.join(named, match_on(before, named, [(k, f"__k_{k}") for k in self.keys], null_safe=True), "left_anti")
        return self._union([*plain, stays, last.filter(~F.col(_GONE))])

    def buckets_of(self, rows: DataFrame) -> set[int]:
        """Buckets that the keys of some rows belong to; at most the table's number of buckets reach the driver."""
        return {r[0] for r in rows.select(self._bucket().alias(_BUCKET)).distinct().collect()}

    # ------------------------------------------------------------ changing

    def write_changes(self, rows: DataFrame, gone: Column | None = None, source: str | None = None, batch: int | None = None) -> KeyedTable:
        """The table with whole new rows (one per key) put in, and those taken out for which ``gone`` holds."""
        if source is not None and (last := self.last_batch(source)) is not None and last >= batch:
            return self
        mark = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
        segment = self._segment(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], mark.alias(_GONE)), "changes")
        return self._publish([*self.manifest["segments"], segment], source, batch)

    def compact(self, most: int = 0) -> KeyedTable:
        """Buckets with more than ``most`` change segments written anew as rows."""
        counts: dict[int, int] = {}
        for s in self._segments("changes"):
            for b in s["buckets"]:
                counts[b] = counts.get(b, 0) + 1
        full = {b for b, n in counts.items() if n > most}
        if not full:
            return self
        fresh = self._segment(self.read(full).withColumn(_GONE, F.lit(False)), "rows")
        kept = [dict(s, buckets=[b for b in s["buckets"] if b not in full]) for s in self.manifest["segments"]]
        # rows come before changes, so that a later change is the last
        return self._publish([fresh, *kept])

    def vacuum(self, versions: int = 3) -> None:
        """Drop all but the newest versions and the segments that none of them holds."""
        first = max(0, self.version - versions + 1)
        folder = f"{self.path}/manifests"
        held = set()
        for n in manifests.numbers(self.spark, folder):
            if n >= first:
                held |= {s["path"].rsplit("/", 1)[1] for s in json.loads(manifests.record(self.spark, folder, n))["segments"]}
        manifests.forget(self.spark, folder, first)
        for name in manifests.listing(self.spark, f"{self.path}/data"):
            if name not in held:
                manifests.remove(self.spark, f"{self.path}/data/{name}")


def fill_missing(table: KeyedTable, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that carry only some ``columns``: the others as the table has them, NULL for unknown keys. Only the buckets of
    the rows' keys are read."""
    others = [f.name for f in table.schema if f.name not in columns]
    if not others:
        return rows
    known = table.read(table.buckets_of(rows)).select(*[F.col(k).alias(f"__k_{k}") for k in table.keys], *others)
    joined = rows.join(known, match_on(rows, known, [(k, f"__k_{k}") for k in table.keys], null_safe=True), "left")
    return joined.drop(*[f"__k_{k}" for k in table.keys])
