"""A table of ties that several jobs may add to, with every change whole or not there at all.

Ties lie in Parquet folders that are written once and never touched again,
``batch=<id>/time=<t>``.  A numbered manifest in ``_log`` names the folders that
make up the table; a change writes new folders first and then publishes the
next manifest under a name that must not exist yet.  A job that dies before
that leaves files that no manifest names; one that finds the number taken looks
at the newer table and does its work again.  Readers hold on to the manifest
they began with, and any version that is still there can be read.

Only metadata goes through the driver: folder names, of which there are as many
as batches times the time steps each has.  ``compact`` joins them.

Publishing needs a file system on which a new name is taken by one writer only:
a link on a local disk, a rename that doesn't replace as HDFS has it.
"""

from __future__ import annotations

import datetime
import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TIE = ("time", "run_index", "pos", "occ", "sub")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Other writers were first every time."""


class Store:
    """Rows in partitions by ``by``, at most one for each ``key`` if they come by ``merge``."""

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = TIE, by: str = "time", tries: int = 20):
        self.spark, self.path, self.key, self.by, self.tries = spark, path.rstrip("/"), key, by, tries

    # --- files
    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @property
    def _fs(self):
        return self._at("_log").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list:
        fs, at = self._fs, self._at(name)
        return list(fs.listStatus(at)) if fs.exists(at) else []

    def _publish(self, manifest: dict) -> bool:
        """Put a manifest in place under its number; False if the number is taken."""
        fs, tmp, to = self._fs, self._at(f"_log/.{uuid.uuid4().hex}"), self._at(f"_log/{manifest['version']:012}.json")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if fs.getScheme() == "file":
                try:
                    os.link(tmp.toUri().getPath(), to.toUri().getPath())
                    return True
                except FileExistsError:
                    return False
            return not fs.exists(to) and bool(fs.rename(tmp, to))
        finally:
            fs.delete(tmp, False)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for x in self._list("_log") if (n := x.getPath().getName()).endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if version is None:
            if not known:
                return {"version": 0, "schema": None, "parts": [], "steps": [], "streams": {}}
            version = known[-1]
        if version not in known:
            raise LookupError(f"no version {version} in {self.path}")
        stream = self._fs.open(self._at(f"_log/{version:012}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # --- reading
    def _frame(self, schema: str, parts: list[dict]) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not parts:
            return self.spark.createDataFrame([], kind)
        paths = [f"{self.path}/{p['dir']}/{self.by}={p['name']}" for p in parts]
        return self.spark.read.schema(kind).option("basePath", self.path).parquet(*paths).select(*kind.names)

    def read(self, version: int | None = None, values: list | None = None) -> DataFrame:
        """The table, or its partitions of ``values``; a filter on the partition column of the result prunes folders as well."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise LookupError(f"nothing was written to {self.path}")
        return self._frame(now["schema"], now["parts"] if values is None else [p for p in now["parts"] if p["value"] in {str(v) for v in values}])

    def done(self, step: str) -> bool:
        return step in self.manifest()["steps"]

    # --- writing
    def _batch(self, rows: DataFrame, as_read: bool = False) -> list[dict]:
        """Write rows to a new batch; the partitions that it has.

        Rows that are dealt by nothing yet are exchanged: a large partition is split and small ones
        are joined as their sizes turn out. What is read from the store and only filtered lies by
        partition already and is written ``as_read``, without an exchange.
        """
        name = f"batch=b{uuid.uuid4().hex[:16]}"
        rows = rows if as_read else rows.hint("rebalance", F.col(self.by))
        rows.sortWithinPartitions(*self.key).write.partitionBy(self.by).parquet(f"{self.path}/{name}")
        found = [x.getPath().getName().partition("=")[2] for x in self._list(name) if x.isDirectory() and "=" in x.getPath().getName()]
        return [{"dir": name, "name": n, "value": None if n == NO_VALUE else unquote(n)} for n in sorted(found)]

    def _schema(self, now: dict, rows: DataFrame) -> str:
        """The table's columns and what ``rows`` adds to them; a column can't change its type."""
        have = {} if now["schema"] is None else {f.name: f for f in StructType.fromJson(json.loads(now["schema"])).fields}
        for f in rows.schema.fields:
            if f.name in have and have[f.name].dataType != f.dataType:
                raise ValueError(f"{f.name} is {have[f.name].dataType.simpleString()} in the store, not {f.dataType.simpleString()}")
            have.setdefault(f.name, f)
        if missing := {*self.key, self.by} - {*rows.columns}:
            raise ValueError(f"columns {sorted(missing)} are needed")
        return StructType(list(have.values())).json()

    def _change(self, work: Callable[[dict], dict | None], step: str | None, stream: tuple[str, int] | None) -> int:
        """Publish what ``work`` makes of the newest manifest, as often as another writer is first. The version it is in.

        A ``step``, or a number of a ``stream`` that isn't larger than its last, that is there already is not done again.
        """
        for _ in range(self.tries):
            now = self.manifest()
            if step in now["steps"] or (stream and stream[1] <= now["streams"].get(stream[0], -1)):
                return now["version"]
            made = work(now)
            if made is None and step is None and stream is None:
                return now["version"]
            made = {**now, **(made or {}), "version": now["version"] + 1, "at": datetime.datetime.now(datetime.UTC).isoformat()}
            made["steps"] = [*now["steps"], step] if step else now["steps"]
            made["streams"] = {**now["streams"], stream[0]: stream[1]} if stream else now["streams"]
            if self._publish(made):
                return made["version"]
        raise Conflict(f"{self.tries} other writers were first in {self.path}")

    def append(self, rows: DataFrame, step: str | None = None, stream: tuple[str, int] | None = None) -> int:
        """Add rows as they are."""
        parts: list[dict] = []

        def work(now: dict) -> dict:
            schema = self._schema(now, rows)
            parts.extend(parts or self._batch(rows))  # written once, whoever is first
            return {"schema": schema, "parts": now["parts"] + parts}

        return self._change(work, step, stream)

    def _single(self, rows: DataFrame) -> DataFrame:
        """One row for each key, the greatest by its other columns in order."""
        rest = [c for c in rows.columns if c not in self.key]
        if not rest:
            return rows.distinct()
        return rows.groupBy(*self.key).agg(F.max(F.struct(*rest)).alias("_v")).select(*self.key, "_v.*").select(*rows.columns)

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        same = F.lit(True)
        for c in self.key:
            same = same & a[c].eqNullSafe(b[c])
        return same

    def merge(self, rows: DataFrame, on_match: str = "keep", step: str | None = None, stream: tuple[str, int] | None = None) -> int:
        """Add the rows whose key the store doesn't have; those it has are kept or, with ``replace``, replaced.

        Of several rows with one key the greatest counts. Only partitions that ``rows`` has are read. To replace, the rest of these is written anew; the rows that came are written once and stay where they are.
        """
        if on_match not in ("keep", "replace"):
            raise ValueError(f"on_match is keep or replace, not {on_match!r}")
        came: list[dict] = []

        def work(now: dict) -> dict:
            schema = self._schema(now, rows)
            came.extend(came or self._batch(self._single(rows)))
            mine = {p["name"] for p in came}
            old = [p for p in now["parts"] if p["name"] in mine]
            both = {p["name"] for p in old}
            parts = now["parts"] + [p for p in came if p["name"] not in both]
            if old:
                own, there = self._frame(rows.schema.json(), [p for p in came if p["name"] in both]), self._frame(schema, old)
                if on_match == "keep":
                    parts = parts + self._batch(own.join(there.select(*self.key), self._same(own, there), "left_anti"))
                else:
                    rest = there.join(own.select(*self.key), self._same(there, own), "left_anti")
                    parts = [p for p in parts if p["name"] not in both] + [p for p in came if p["name"] in both] + self._batch(rest)
            return {"schema": schema, "parts": parts}

        return self._change(work, step, stream)

    def replace(self, which: Column | None, rows: DataFrame | None, step: str | None = None) -> int:
        """Delete the rows for which ``which`` is true and add ``rows``, in one change. Only partitions that hold such rows are written anew. How many went."""
        gone, made = [0], []

        def work(now: dict) -> dict | None:
            schema, parts, gone[0] = now["schema"], now["parts"], 0
            if which is not None and parts:
                have = self._frame(schema, parts)
                hit = {r["_p"]: r["n"] for r in have.where(which).groupBy(F.col(self.by).cast("string").alias("_p")).agg(F.count("*").alias("n")).collect()}  # one row per partition
                if hit:
                    old = [p for p in parts if p["value"] in hit]
                    parts = [p for p in parts if p["value"] not in hit] + self._batch(self._frame(schema, old).where(~F.coalesce(which, F.lit(False))), as_read=True)
                    gone[0] = sum(hit.values())
            if rows is not None:
                schema = self._schema(now, rows)
                made.extend(made or self._batch(rows))
                parts = parts + made
            return None if parts is now["parts"] else {"schema": schema, "parts": parts}

        self._change(work, step, None)
        return gone[0]

    def delete(self, which: Column) -> int:
        return self.replace(which, None)

    def drop(self, values: list | None = None) -> int:
        """Leave out whole partitions, all of them without ``values``; no data are read."""
        mine = None if values is None else {None if v is None else str(v) for v in values}

        def work(now: dict) -> dict | None:
            parts = [p for p in now["parts"] if mine is not None and p["value"] not in mine]
            return None if len(parts) == len(now["parts"]) else {"parts": parts}

        return self._change(work, None, None)

    def compact(self) -> int:
        """Join the folders of every partition that has several."""

        def work(now: dict) -> dict | None:
            names = [p["name"] for p in now["parts"]]
            several = {n for n in names if names.count(n) > 1}
            if not several:
                return None
            old = [p for p in now["parts"] if p["name"] in several]
            return {"parts": [p for p in now["parts"] if p["name"] not in several] + self._batch(self._frame(now["schema"], old))}

        return self._change(work, None, None)

    def vacuum(self, keep: int = 1, older_than: float = 7 * 86400) -> list[str]:
        """Remove manifests before the last ``keep`` and batches that none of these name, if they are older than so many seconds: a job may still be writing or reading younger ones."""
        known = self.versions()
        live = {p["dir"] for v in known[-keep:] for p in self.manifest(v)["parts"]}
        for v in known[:-keep]:
            self._fs.delete(self._at(f"_log/{v:012}.json"), False)
        limit = (datetime.datetime.now(datetime.UTC).timestamp() - older_than) * 1000
        gone = [x.getPath().getName() for x in self._list("") if x.getPath().getName().startswith("batch=") and x.getPath().getName() not in live and x.getModificationTime() <= limit]
        for name in gone:
            self._fs.delete(self._at(name), True)
        return gone


class OccurrenceCache:
    """Sums of occurrences for each folder of a store of ties, so that only folders that are new are read.

    A store's folders never change, so a folder's name is the fingerprint of its files. Sums of the folders
    that a version has add up to the whole's.
    """

    def __init__(self, store: Store):
        self.store = store
        self.kept = Store(store.spark, f"{store.path}/_occurrences", key=("part", "occ"), by="part")
        self.read_parts = 0

    @staticmethod
    def _name(part: dict) -> str:
        return f"{part['dir'].partition('=')[2]}-{part['name']}"

    def refresh(self, version: int | None = None) -> list[str]:
        """Add the sums of new folders and leave out those of folders that are gone; the new ones."""
        now = self.store.manifest(version)
        live, have = {self._name(p): p for p in now["parts"]}, {p["value"] for p in self.kept.manifest()["parts"]}
        new = sorted(set(live) - have)
        if stale := have - set(live):
            self.kept.drop(sorted(stale))
        if new:
            frames = self.store._frame(now["schema"], [live[n] for n in new])
            # the folder that a row lies in is known from its path
            part = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/batch="), -1), f"/{self.store.by}=([^/]*)/.*$", "-$1")
            rows = frames.select(part.alias("part"), "time", "occ", "weight").groupBy("part", "time", "occ").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
            self.kept.merge(rows)  # another reader may add the same folder
        self.read_parts += len(new)
        return new

    def occurrences(self, ids=None, times=None, version: int | None = None) -> DataFrame:
        """(token_id, freq), as ``queries.occurrences`` without a cutoff or a context has them."""
        self.refresh(version)
        rows = self.kept.read()
        if isinstance(times, dict):
            rows = rows.where(F.col("time").between(times["start"], times["end"]))
        elif times is not None:
            rows = rows.where(F.col("time").isin(*([times] if isinstance(times, int) else times)))
        if ids is not None:
            rows = rows.where(F.col("occ").isin(*([ids] if isinstance(ids, int) else ids)))
        return rows.groupBy(F.col("occ").alias("token_id")).agg(F.round(F.sum("weight")).alias("freq"))
