"""Dedup keys that persist between runs.

The store is a log of runs in one folder. A run adds three Parquet tables, each with
what it changed only: ``hash_key`` (which key a data hash has now), ``key_identifier`` and
``key_hash`` (what was linked to a key, in order). A row in ``runs`` commits it, so a run
that dies halfway leaves nothing behind. ``compact`` writes the state as one run that
replaces the earlier ones for readers.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlink.operators.storage import materialize
from contactlink.sources.levels import LevelledTable

HASH_KEY = "data_hash string, dedup_key string, run_no bigint"
KEY_IDENTIFIER = "dedup_key string, identifier string, run_no bigint, ord bigint"
KEY_HASH = "dedup_key string, data_hash string, run_no bigint, ord bigint"
KEY_ALIAS = "alias string, dedup_key string, run_no bigint"
RUNS = "run_no bigint, run_id string, path string, is_base boolean, committed_at string"
VERSION = "2.0"


@dataclass
class KeyState:
    """The store as tables: current key per hash, linked identifiers and hashes per key."""

    hash_key: DataFrame
    key_identifier: DataFrame
    key_hash: DataFrame

    def of_hashes(self, hashes: DataFrame) -> KeyState:
        """The state as far as it concerns the column ``data_hash``; this one is whole already."""
        return self

    def of_keys(self, keys: DataFrame) -> KeyState:
        """The same for what is linked to the column ``dedup_key``."""
        return self


@dataclass
class MergedState(KeyState):
    """With the keys that became another key when a run brought their clusters together."""

    key_alias: DataFrame | None = None


def empty_state(spark: SparkSession) -> KeyState:
    return KeyState(*(spark.createDataFrame([], s) for s in (HASH_KEY, KEY_IDENTIFIER, KEY_HASH)))


class KeyStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def runs(self) -> DataFrame:
        """Committed runs. A folder that does not exist is an empty store; a damaged one raises."""
        try:
            return self.spark.read.schema(RUNS).parquet(f"{self.path}/runs")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in (error.getCondition() or ""):
                return self.spark.createDataFrame([], RUNS)
            raise

    def _log(self) -> list:
        log = sorted(self.runs().collect(), key=lambda r: r.run_no)
        if len({r.run_no for r in log}) != len(log):
            raise RuntimeError(f"two writers committed the same run to {self.path}")
        return log

    def has_run(self, run_id: str) -> bool:
        return not self.runs().filter(F.col("run_id") == run_id).isEmpty()

    def total_runs(self) -> int:
        return sum(not r.is_base for r in self._log())

    def state(self) -> KeyState:
        """Current state: the latest base and the runs after it.

        The last writer of a hash wins, the first link of an identifier counts. Both are
        aggregates on the key of the join that follows, so they add no shuffle to it.
        """
        log = self._log()
        base = max((i for i, r in enumerate(log) if r.is_base), default=0)
        parts = [r.path for r in log[base:]]
        if not parts:
            return empty_state(self.spark)

        def table(name: str, schema: str) -> DataFrame:
            return self.spark.read.schema(schema).parquet(*(f"{p}/{name}" for p in parts))

        hash_key, identifier, key_hash = (
            table(n, s) for n, s in (("hash_key", HASH_KEY), ("key_identifier", KEY_IDENTIFIER), ("key_hash", KEY_HASH))
        )
        aliases = self.aliases()
        if aliases is not None:
            hash_key, identifier, key_hash = (with_current_key(t, aliases, "dedup_key") for t in (hash_key, identifier, key_hash))
        if len(parts) == 1 and aliases is None:
            return KeyState(hash_key, identifier, key_hash)
        first = F.min(F.struct("run_no", "ord")).alias("at")
        return KeyState(
            hash_key.groupBy("data_hash").agg(F.max_by("dedup_key", "run_no").alias("dedup_key"), F.max("run_no").alias("run_no")),
            identifier.groupBy("dedup_key", "identifier").agg(first).select("dedup_key", "identifier", "at.*"),
            key_hash.groupBy("dedup_key", "data_hash").agg(first).select("dedup_key", "data_hash", "at.*"),
        )

    def aliases(self) -> DataFrame | None:
        """``alias, dedup_key`` with every merged key at its last one; None if no run merged keys."""
        known = []
        for path in (r.path for r in self._log()):
            try:
                known.append(self.spark.read.schema(KEY_ALIAS).parquet(f"{path}/key_alias"))
            except AnalysisException as error:  # a run that merged no keys has no such table
                if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
                    raise
        return followed(reduce(DataFrame.unionByName, known)) if known else None

    def commit(self, changes: KeyState, run_id: str | None = None, at: datetime | None = None) -> int:
        """Write the changes of a run and publish them. A run id that is already there is
        left alone, so a replay changes nothing."""
        run_id = run_id or uuid.uuid4().hex
        if self.has_run(run_id):
            return self.total_runs()
        self._publish(changes, run_id, at, is_base=False)
        return self.total_runs()

    def compact(self, at: datetime | None = None) -> None:
        self._publish(self.state(), f"compact-{uuid.uuid4().hex}", at, is_base=True)

    def _claimed(self, after: int) -> int:
        """The next free run number. A file that only one writer can create claims it, so two writers never share one;
        the number of a writer that died stays unused."""
        context = self.spark.sparkContext
        number = after + 1
        while True:
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/claims/{number:010d}")
            if path.getFileSystem(context._jsc.hadoopConfiguration()).createNewFile(path):
                return number
            number += 1

    def _publish(self, tables: KeyState, run_id: str, at: datetime | None, is_base: bool) -> None:
        log = self._log()
        run_no = self._claimed(log[-1].run_no if log else 0)
        folder = f"{self.path}/data/{run_no:010d}-{uuid.uuid4().hex}"
        for name in ("hash_key", "key_identifier", "key_hash", "key_alias"):
            table = getattr(tables, name, None)
            if table is None:
                continue
            if not is_base:
                table = table.withColumn("run_no", F.lit(run_no).cast("long"))
            table.write.parquet(f"{folder}/{name}")
        when = (at or datetime.now(timezone.utc)).replace(tzinfo=None).isoformat()
        row = self.spark.createDataFrame([(run_no, run_id, folder, is_base, when)], RUNS)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/runs")


def followed(aliases: DataFrame) -> DataFrame:
    """``alias, dedup_key`` with every alias at its last key, by pointer jumping: each round halves the way that is left.

    Of an alias that was given several keys, the latest ``run_no`` counts if there is that column.
    """
    if "run_no" in aliases.columns:
        aliases = aliases.groupBy("alias").agg(F.max_by("dedup_key", "run_no").alias("dedup_key"))
    now = materialize(aliases.select("alias", "dedup_key"), "aliases")
    while True:
        ahead = now.select(F.col("alias").alias("dedup_key"), F.col("dedup_key").alias("_ahead"))
        jumped = now.join(ahead, "dedup_key", "left")
        jumped = materialize(jumped.select("alias", F.coalesce("_ahead", "dedup_key").alias("dedup_key"), F.col("_ahead").isNotNull().alias("_moved")), "aliases")
        now = jumped.drop("_moved")
        if jumped.filter("_moved").isEmpty():
            return now


def with_current_key(df: DataFrame, aliases: DataFrame, key: str = "DEDUP_KEY") -> DataFrame:
    """Replace keys that were merged into others since ``df`` was written; ``aliases`` as ``KeyStore.aliases`` gives them."""
    known = aliases.select(F.col("alias").alias(key), F.col("dedup_key").alias("_current"))
    return df.join(known, key, "left").withColumn(key, F.coalesce("_current", key)).drop("_current").select(df.columns)


def import_mappings(documents: DataFrame, column: str = "value") -> KeyState:
    """Key state out of mapping documents in JSON, one per row."""
    schema = (
        "data_hash_to_key map<string,string>, key_to_data_hashes map<string,array<string>>, "
        "key_to_identifiers map<string,array<string>>"
    )
    parsed = documents.select(
        F.from_json(F.col(column), schema, {"mode": "FAILFAST"}).alias("m")
    )
    run_no = F.lit(0).cast("long").alias("run_no")

    def linked(source: str, name: str) -> DataFrame:
        lists = parsed.select(F.explode(f"m.{source}").alias("dedup_key", "items"))
        return lists.select("dedup_key", F.posexplode("items").alias("pos", name)).select(
            "dedup_key", name, run_no, F.col("pos").cast("long").alias("ord")
        )

    keys = parsed.select(F.explode("m.data_hash_to_key").alias("data_hash", "dedup_key"))
    return KeyState(
        keys.select("data_hash", "dedup_key", run_no),
        linked("key_to_identifiers", "identifier"),
        linked("key_to_data_hashes", "data_hash"),
    )


def hashes_per_key(state: KeyState) -> DataFrame:
    """``dedup_key, data_hashes``: hashes that have or had the key, in link order."""
    return _lists(state.key_hash, "data_hash", "data_hashes")


def identifiers_per_key(state: KeyState) -> DataFrame:
    """``dedup_key, identifiers`` in link order."""
    return _lists(state.key_identifier, "identifier", "identifiers")


def _lists(links: DataFrame, item: str, out: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("run_no", "ord", item)))
    return links.groupBy("dedup_key").agg(ordered.getField(item).alias(out))


@dataclass
class AskedState(KeyState):
    """State of a levelled store: empty until it is asked about hashes and keys."""

    store: LevelledKeyStore | None = None

    def of_hashes(self, hashes: DataFrame) -> KeyState:
        return replace(self, hash_key=self.store.hash_key.ask(hashes).rows)

    def of_keys(self, keys: DataFrame) -> KeyState:
        wanted = materialize(keys.select("dedup_key").distinct(), "asked-keys")
        return replace(self, key_identifier=self.store.key_identifier.ask(wanted).rows, key_hash=self.store.key_hash.ask(wanted).rows)


class LevelledKeyStore:
    """A key store whose runs read what concerns them only; see ``levels``. Used like ``KeyStore``.

    A run's links are published before its hashes, whose manifest commits the run; a replay of a run that died in between
    adds what is missing. Runs in cluster mode that merge stored keys need a ``KeyStore``.
    """

    def __init__(self, spark: SparkSession, path: str, **layout: int):
        self.spark, self.path = spark, path.rstrip("/")
        table = lambda name, *rest, **more: LevelledTable(spark, f"{self.path}/{name}", *rest, **more, **layout)
        self.hash_key = table("hash_key", HASH_KEY, "data_hash")
        self.key_identifier = table("key_identifier", KEY_IDENTIFIER, "dedup_key", identity=["dedup_key", "identifier"], keep_first=True)
        self.key_hash = table("key_hash", KEY_HASH, "dedup_key", identity=["dedup_key", "data_hash"], keep_first=True)

    def has_run(self, run_id: str) -> bool:
        return run_id in self.hash_key.runs()

    def total_runs(self) -> int:
        return len(self.hash_key.runs())

    def state(self) -> KeyState:
        empty = empty_state(self.spark)
        return AskedState(empty.hash_key, empty.key_identifier, empty.key_hash, store=self)

    def whole_state(self) -> KeyState:
        """All of it, for reports."""
        return KeyState(self.hash_key.rows(), self.key_identifier.rows(), self.key_hash.rows())

    def commit(self, changes: KeyState, run_id: str | None = None, at: datetime | None = None) -> int:
        if isinstance(changes, MergedState):
            raise ValueError("a run that merges stored keys needs a KeyStore")
        run_id = run_id or uuid.uuid4().hex
        for name in ("key_identifier", "key_hash", "hash_key"):
            getattr(self, name).add(getattr(changes, name), run_id)
        return self.total_runs()
