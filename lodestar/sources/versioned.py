"""A versioned key-value table: immutable Parquet files and an atomically created log.

A commit writes its files first and then creates ``_log/<version>.json`` without
overwriting, so of two writers one wins and the other tries again on the new head.
A reader replays the log from the newest checkpoint, prunes files by their key range
before Spark sees them, and keeps the greatest (version, ordinal) of each key.
"""

from __future__ import annotations

import json
import random
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,127}")
_CHECKPOINT = 10
_SMALL = 1 << 20


class TableError(RuntimeError):
    """A table that cannot do what is asked."""


class Conflict(TableError):
    """Other writers won every try."""


class Corrupt(TableError):
    """A log with a gap or an entry that does not parse."""


@dataclass
class State:
    version: int = 0
    files: dict[str, dict] = field(default_factory=dict)

    def apply(self, entry: dict) -> None:
        if entry["version"] != self.version + 1:
            raise Corrupt(f"version {entry['version']} follows {self.version}")
        for path in entry["remove"]:
            self.files.pop(path, None)
        for f in entry["add"]:
            self.files[f["path"]] = {**f, "since": entry["version"]}
        self.version = entry["version"]


class VersionedTable:
    """``VersionedTable(spark, root, name)``; nothing is written until the first commit."""

    def __init__(self, spark: SparkSession, root: str, name: str, tries: int = 32):
        if not _NAME.fullmatch(name):
            raise TableError(f"{name!r} is no table name")
        self.spark, self.path, self.tries = spark, f"{root.rstrip('/')}/{name}", tries
        jvm = spark.sparkContext._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Log

    def _names(self) -> list[str]:
        log = self._jpath(f"{self.path}/_log")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(log)) if self._fs.exists(log) else []

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._jpath(f"{self.path}/_log/{name}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError as e:
            raise Corrupt(f"{name} does not parse") from e

    def _create(self, name: str, value: dict) -> bool:
        """False if the name is taken."""
        whole = self._jpath(f"{self.path}/_log/{name}")
        if self._fs.exists(whole):
            return False
        try:
            out = self._fs.create(whole, False)
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        return True

    def state(self, version: int | None = None) -> State:
        names = self._names()
        logged = sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d{20}\.json", n))
        head = logged[-1] if logged else 0
        if version is not None and not 0 <= version <= head:
            raise TableError(f"there is no version {version}; the latest is {head}")
        until = head if version is None else version
        points = [int(n[:20]) for n in names if n.endswith(".checkpoint.json") and int(n[:20]) <= until]
        state = State()
        if points:
            held = self._read(f"{max(points):020d}.checkpoint.json")
            state = State(held["version"], held["files"])
        for v in range(state.version + 1, until + 1):
            if v not in set(logged):
                raise Corrupt(f"version {v} is missing")
            state.apply(self._read(f"{v:020d}.json"))
        return state

    def version(self) -> int:
        return self.state().version

    def _commit(self, op: str, add: list[dict], remove: list[str] = (), base: State | None = None) -> int:
        for k in range(self.tries):
            state = self.state()
            if base is not None and any(p not in state.files for p in remove):
                raise Conflict("files to replace are gone")
            entry = {"version": state.version + 1, "parent": state.version, "ts": time.time(), "op": op, "add": add, "remove": list(remove)}
            if self._create(f"{entry['version']:020d}.json", entry):
                if entry["version"] % _CHECKPOINT == 0:
                    state.apply(entry)
                    self._create(f"{state.version:020d}.checkpoint.json", {"version": state.version, "files": state.files})
                return entry["version"]
            time.sleep(random.uniform(0, min(1.0, 0.01 * 2**k)))
        raise Conflict(f"{self.tries} tries were lost")

    # Writes

    def _write(self, rows: DataFrame) -> list[dict]:
        """One directory of files; its key range and counts come from one pass over what was written."""
        name = uuid.uuid4().hex
        rows.sortWithinPartitions("key").write.parquet(f"{self.path}/data/{name}")
        got = self.spark.read.parquet(f"{self.path}/data/{name}").agg(F.count("*"), F.min("key"), F.max("key"), F.count_if(F.col("op") == "del")).first()
        size = self._fs.getContentSummary(self._jpath(f"{self.path}/data/{name}")).getLength()
        return [{"path": name, "rows": got[0], "min": got[1], "max": got[2], "dels": got[3], "bytes": size}] if got[0] else []

    def put(self, rows: DataFrame) -> int:
        """Commit (key, payload); of a key given twice the greatest payload stays. Returns the version."""
        one = rows.groupBy(F.col("key").cast("string").alias("key")).agg(F.max(F.col("payload").cast("binary")).alias("payload"))
        return self._commit("put", self._write(self._rows(one, "put")))

    def delete(self, keys: DataFrame) -> int:
        one = keys.select(F.col("key").cast("string").alias("key")).distinct().withColumn("payload", F.lit(None).cast("binary"))
        return self._commit("delete", self._write(self._rows(one, "del")))

    def _rows(self, rows: DataFrame, op: str) -> DataFrame:
        return rows.where("key is not null").select("key", F.lit(op).alias("op"), F.current_timestamp().alias("ts"), "payload", F.lit(0).cast("long").alias("ver"), F.monotonically_increasing_id().alias("ord"))

    # Reads

    def _scan(self, files: dict[str, dict]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], "key string, op string, ts timestamp, payload binary, ver long, ord long")
        rows = self.spark.read.parquet(*[f"{self.path}/data/{p}" for p in files])
        since = F.create_map(*[F.lit(x) for p, f in files.items() for x in (p, f["since"])])
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]{32})/", 1)
        return rows.withColumn("ver", F.when(F.col("ver") == 0, F.element_at(since, name)).otherwise(F.col("ver")).cast("long"))

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct("op", "ts", "payload", "ver", "ord"), F.struct("ver", "ord"))
        return rows.groupBy("key").agg(last.alias("r")).select("key", "r.*")

    def scan(self, prefix: str = "", version: int | None = None) -> DataFrame:
        """Live (key, payload, ver, ts) with keys that start with ``prefix``, as of ``version``."""
        files = {p: f for p, f in self.state(version).files.items() if f["max"] >= prefix and (f["min"] <= prefix or f["min"].startswith(prefix))}
        rows = self._scan(files)
        rows = rows.where(F.col("key").startswith(prefix)) if prefix else rows
        return self._latest(rows).where("op = 'put'").select("key", "payload", "ver", "ts")

    def get(self, key: str, version: int | None = None) -> bytes | None:
        files = {p: f for p, f in self.state(version).files.items() if f["min"] <= key <= f["max"]}
        row = self._latest(self._scan(files).where(F.col("key") == key)).where("op = 'put'").first()
        return bytes(row.payload) if row else None

    def changes(self, after: int, prefix: str = "") -> DataFrame:
        """(key, op, payload, ver, ord) committed after version ``after``; order by ver, ord."""
        files = self.state().files
        if after >= max((f["since"] for f in files.values()), default=0):
            files = {}
        rows = self._scan({p: f for p, f in files.items() if f["since"] > after}).where(F.col("ver") > after)
        return rows.where(F.col("key").startswith(prefix)).select("key", "op", "payload", "ver", "ord")

    # Upkeep

    def compact(self) -> int | None:
        """Merge small or tombstone-heavy files into one; tombstones go only if all files are merged."""
        state = self.state()
        old = [p for p, f in state.files.items() if f["bytes"] < _SMALL or f["dels"] >= 0.3 * f["rows"]]
        if len(old) < 2:
            return None
        rows = self._latest(self._scan({p: state.files[p] for p in old}))
        if len(old) == len(state.files):
            rows = rows.where("op = 'put'")
        add = self._write(rows.select("key", "op", "ts", "payload", "ver", "ord").coalesce(1))
        return self._commit("compact", add, old, state)

    def vacuum(self, keep_s: float = 600.0) -> list[str]:
        """Delete data that no version since the retention uses; at least ten minutes are kept."""
        live = set(self.state().files)
        data, gone = self._jpath(f"{self.path}/data"), []
        before = (time.time() - max(600.0, keep_s)) * 1000
        for f in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f.getPath().getName() not in live and f.getModificationTime() < before:
                self._fs.delete(f.getPath(), True)
                gone.append(f.getPath().getName())
        return gone
