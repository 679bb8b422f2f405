"""Tables that change: copied on write by hash bucket, published by one manifest.

A table is a folder of data folders, each split by bucket, and of numbered manifests. The newest manifest says which
folders make up each bucket. A keyed write reads and writes only the buckets that its keys fall into; readers see the table before it
until its manifest has been put in place by one rename, so a job that dies at any step leaves the table as it was.
Every data folder is written once. One writer at a time; a writer that finds its manifest's number taken raises.

A write may carry the number of a micro-batch. It then builds on the state before that batch, whatever had been published for it, so
a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.operators import writes
from emberline.session import shuffles_removed

BUCKETS = 16


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # files

    def _at(self, *parts: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _numbers(self) -> list[int]:
        """Numbers of the manifests, newest first."""
        fs, where = self._at("manifests")
        found = fs.listStatus(where) if fs.exists(where) else []
        return sorted((int(n[:-5]) for f in found if (n := f.getPath().getName()).endswith(".json") and not n.startswith(".")), reverse=True)

    def _load(self, number: int) -> dict:
        fs, where = self._at("manifests", f"{number:012d}.json")
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"number": number}
        finally:
            stream.close()

    def manifest(self, before: int | None = None) -> dict | None:
        """The newest manifest, or the newest of a batch below ``before``; None where nothing was written."""
        for number in self._numbers():
            found = self._load(number)
            if before is None or found["batch"] is None or found["batch"] < before:
                return found
        return None

    def _publish(self, manifest: dict) -> None:
        number = (self._numbers() or [0])[0] + 1
        fs, fresh = self._at("manifests", f".{uuid.uuid4().hex}")
        stream = fs.create(fresh, False)
        stream.write(bytearray(json.dumps({k: v for k, v in manifest.items() if k != "number"}).encode()))
        stream.close()
        _, there = self._at("manifests", f"{number:012d}.json")
        if fs.exists(there) or not fs.rename(fresh, there):
            raise OSError(f"another writer has published {there}")

    def _write(self, rows: DataFrame, by_bucket: bool) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        with shuffles_removed(self.spark):
            if by_bucket:
                rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            else:
                rows.write.parquet(f"{self.path}/{folder}")
        return folder

    # reading

    def _frame(self, manifest: dict, parts: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in parts])

    def read(self, like: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """The table; before its first write an empty one like ``like``."""
        found = self.manifest(before)
        if found is None:
            if like is None:
                raise FileNotFoundError(self.path)
            return like.limit(0)
        return self._frame(found, [p for parts in found["parts"].values() for p in parts])

    def _bucket(self, manifest: dict | None, keys: list[str]) -> Column:
        n = manifest["buckets"] if manifest and manifest["keys"] == keys else self.buckets
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(n)).cast("int")

    def lookup(self, rows: DataFrame, keys: list[str], like: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """The rows of the buckets that the keys of ``rows`` fall into; the whole table where it is not kept by these keys."""
        found = self.manifest(before)
        if found is None or found["keys"] != keys:
            return self.read(like, before)
        met = [r[0] for r in rows.select(self._bucket(found, keys)).distinct().collect()]
        return self._frame(found, [p for b in met for p in found["parts"].get(str(b), [])])

    # writing

    def replace(self, table: DataFrame, batch: int | None = None, note: dict | None = None) -> None:
        """The table becomes ``table``, which may have been read from it."""
        self._publish({"schema": table.schema.jsonValue(), "keys": [], "buckets": 0, "parts": {"*": [self._write(table, False)]}, "batch": batch, "note": note or {}})

    def append(self, rows: DataFrame, batch: int | None = None, note: dict | None = None) -> None:
        """More rows; of a table kept by keys each goes to its bucket."""
        old = self.manifest(batch)
        if old is None:
            return self.replace(rows, batch, note)
        rows = rows.select(*T.StructType.fromJson(old["schema"]).fieldNames())
        keys, parts = old["keys"], {b: list(p) for b, p in old["parts"].items()}
        if keys:
            met = self._put(rows, self._bucket(old, keys))
            for b, folder in met.items():
                parts.setdefault(b, []).append(folder)
        else:
            parts.setdefault("*", []).append(self._write(rows, False))
        self._publish(old | {"parts": parts, "batch": batch, "note": note or old["note"]})
        return None

    def _put(self, rows: DataFrame, bucket: Column) -> dict[str, str]:
        """Write ``rows`` by bucket; the folder of each bucket that has rows."""
        folder = self._write(rows.withColumn("_bucket", bucket), True)
        fs, where = self._at(folder)
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def merge(self, rows: DataFrame, keys: list[str], how: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None, note: dict | None = None) -> list[str]:
        """``how(old, new)`` in place of the old rows of every bucket that ``rows`` touch; the names of those buckets.

        A table that was not kept by these keys is dealt into buckets first, which writes it whole once.
        """
        old = self.manifest(batch)
        bucket = self._bucket(old, keys)
        n = old["buckets"] if old and old["keys"] == keys else self.buckets
        if old and old["keys"] == keys:
            met = [str(r[0]) for r in rows.select(bucket).distinct().collect()]
            if not met:
                self._publish(old | {"batch": batch, "note": note or old["note"]})
                return []
            before = self._frame(old, [p for b in met for p in old["parts"].get(b, [])])
            parts = {b: p for b, p in old["parts"].items() if b not in met}
        else:
            before = self._frame(old, [p for parts in old["parts"].values() for p in parts]) if old else rows.limit(0)
            parts, met = {}, [str(b) for b in range(n)]
        table = how(before, rows)
        parts |= {b: [folder] for b, folder in self._put(table, bucket).items()}
        self._publish({"schema": table.schema.jsonValue(), "keys": keys, "buckets": n, "parts": parts, "batch": batch, "note": note or (old or {}).get("note", {})})
        return met

    def upsert(self, rows: DataFrame, keys: list[str], order: str, keep: tuple[str, ...] = (), batch: int | None = None) -> list[str]:
        """Last write wins per key; the columns ``keep`` stay as first written."""
        return self.merge(rows, keys, lambda old, new: writes.upsert(old, new, keys, order, keep), batch)

    def insert_ignore(self, rows: DataFrame, keys: list[str], order: str, batch: int | None = None) -> list[str]:
        """Keep what is there; add the rows whose keys are new."""
        return self.merge(rows, keys, lambda old, new: writes.insert_ignore(old, new, keys, order), batch)

    def settle(self, batch: int) -> int:
        """Delete what neither ``batch``, however often it is repeated, nor a later one builds on; readers of older states must have ended."""
        found = self.manifest(batch)
        return self.vacuum(keep=self._numbers().index(found["number"]) + 1) if found else 0

    def vacuum(self, keep: int = 2) -> int:
        """Delete all manifests but the newest ``keep``, and the data folders that none of them names; how many folders went."""
        numbers = self._numbers()
        used = {p for n in numbers[:keep] for parts in self._load(n)["parts"].values() for p in parts}
        for n in numbers[keep:]:
            fs, where = self._at("manifests", f"{n:012d}.json")
            fs.delete(where, False)
        fs, data = self._at("data")
        names = lambda where: [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        gone = 0
        for folder in (f"data/{n}" for n in names(data)):
            inner = [f"{folder}/{n}" for n in names(self._at(folder)[1]) if n.startswith("_bucket=")]
            for path in [folder] if folder not in used and not used & set(inner) else [p for p in inner if p not in used and folder not in used]:
                fs.delete(self._at(path)[1], True)
                gone += 1
        return gone
