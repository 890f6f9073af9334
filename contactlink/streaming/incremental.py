"""Incremental runs over arriving files, keys held as state of a stream, and stateless enrichment of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from contactlink.functions.keys import minted_key
from contactlink.operators.standardize import standardize, with_data_hash, with_quality
from contactlink.operators.storage import materialize, work_dir
from contactlink.plans.run import run_with_store
from contactlink.sources.files import CSV_GLOB, csv_options
from contactlink.sources.keystore import KeyState, KeyStore, LevelledKeyStore


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_folder(spark: SparkSession, path: str, columns: list[str], max_files: int | None = None, multi_line: bool = True) -> DataFrame:
    """Stream of the CSV files of a drop folder. A file whose header has other names or another order fails the stream
    instead of exchanging columns. ``multi_line=False`` lets large files without line breaks in quotes be split."""
    options = csv_options(multi_line) | {"pathGlobFilter": CSV_GLOB, "enforceSchema": False}
    reader = spark.readStream.schema(text_schema(columns)).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.csv(path)


def incremental_dedup(
    stream: DataFrame, store_path: str, output: str, checkpoint: str, name: str = "dedup", order: str | None = None,
    levelled: bool = False, **options
) -> StreamingQuery:
    """Match every micro-batch against the key store and add its keys to it. With ``levelled`` the store is a
    ``LevelledKeyStore``: a batch reads the ranges that may hold its hashes instead of aggregating the whole log.

    A batch writes its own folder under ``output`` and commits under its batch id. After a
    failure the batch is repeated: an uncommitted one overwrites its folder, a committed
    one is skipped.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        store = (LevelledKeyStore if levelled else KeyStore)(batch.sparkSession, store_path)
        run_id = f"{name}-{batch_id}"
        if not store.has_run(run_id):
            if order is not None:
                # A batch of a few large files would be cleaned by a task for each, at every use. Without an order the
                # place in its file is a record's number, so then it stays where it is.
                batch = materialize(batch.repartition(max(1, batch.sparkSession.sparkContext.defaultParallelism)), "batch")
            run_with_store(batch, store, f"{output}/batch={batch_id}", run_id, order=order, **options)

    return (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


#: What a batch adds to a hash: its records, the first of them, and whether the hash was unknown before.
HASH_KEYS = "data_hash string, dedup_key string, first_ord long, n_records long, is_new boolean"
_SUMS = "data_hash string, minted string, first_ord long, n_records long"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per hash of each batch, so the records of a popular hash do not all go to its task."""
    for batch in batches:
        sums = pa.Table.from_batches([batch]).group_by(["data_hash", "minted"]).aggregate([("ord", "min"), ([], "count_all")])
        sums = sums.select(["data_hash", "minted", "ord_min", "count_all"]).rename_columns(["data_hash", "minted", "first_ord", "n_records"])
        yield from sums.to_batches()


#: Hashes are dealt to this many groups of state; a group's call handles all its hashes of a batch.
HASH_GROUPS = 4096


def _hash_group() -> Column:
    return F.pmod(F.xxhash64("data_hash"), F.lit(HASH_GROUPS)).cast("int").alias("hash_group")


class _HashKeys(StatefulProcessor):
    """The key of a hash is its state: the one it had at the start, or the one minted when it was first seen.

    A group of hashes has a map with a row of the store for each hash, so a batch reads and writes its own hashes only.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keys = handle.getMapState("dedup_keys", "data_hash string", "dedup_key string")
        self.group, self.begun = None, {}

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        # All that the group has in its first batch, so its records need not ask the store.
        self.group, self.begun = key, dict(zip(initialState["data_hash"], initialState["dedup_key"]))
        for data_hash, dedup_key in zip(initialState["data_hash"], initialState["dedup_key"]):
            self.keys.updateValue((data_hash,), (dedup_key,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A group has few hashes, so plain sums take a fraction of the time of a table's.
        sums: dict[str, list] = {}
        for part in rows:
            firsts = part["first_ord"].astype("Int64").to_numpy(object, na_value=None)
            for data_hash, minted, first, n in zip(part["data_hash"], part["minted"], firsts, part["n_records"]):
                mine = sums.setdefault(data_hash, [minted, None, 0])
                mine[1] = first if mine[1] is None else mine[1] if first is None else min(mine[1], first)
                mine[2] += n
        kept, new = [], []
        for data_hash, (minted, _, _) in sums.items():
            if key == self.group:
                known = self.begun.get(data_hash)
            else:
                stored = self.keys.getValue((data_hash,))
                known = None if stored is None else stored[0]
            if known is None:
                self.keys.updateValue((data_hash,), (minted,))
                if key == self.group:
                    self.begun[data_hash] = minted
            kept.append(minted if known is None else known)
            new.append(known is None)
        _, firsts, counts = zip(*sums.values())
        yield pd.DataFrame({"data_hash": list(sums), "dedup_key": kept, "first_ord": pd.array(firsts, "Int64"), "n_records": counts, "is_new": new})

    def close(self) -> None:
        pass


def stateful_keys(stream: DataFrame, output: str, checkpoint: str, order: str, known: KeyState | None = None) -> StreamingQuery:
    """Write ``data_hash, dedup_key, first_ord, n_records, is_new`` for every hash of every micro-batch.

    Keys are the keyed state of the stream, so a batch reads and writes only what it has itself, however many came before.
    ``known`` gives the hashes that have keys already, when the stream starts for the first time; after a failure the
    checkpoint has them, and a batch that is repeated gives the rows it gave before. Records that arrive again have the
    key they had and are not new. Records without an order number count as their hash's, and not as its first; a hash has
    no first if all are. Partners are not looked for and keys that records bring along are not read:
    ``incremental_dedup`` does that.
    """
    spark = stream.sparkSession
    hashes = with_data_hash(standardize(stream)).select(
        "data_hash", minted_key(F.col("data_hash")).alias("minted"), F.col(f"`{order}`").cast("long").alias("ord"))
    seeds = None
    if known:
        latest = known.hash_key.groupBy("data_hash").agg(F.max_by("dedup_key", "run_no").alias("dedup_key"))
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(work_dir(spark))
        # A plan over files cannot be sent to the tasks that start the state; a checkpoint can.
        seeds = latest.select(_hash_group(), "data_hash", "dedup_key").checkpoint().groupBy("hash_group")
    keyed = hashes.mapInArrow(_summed, _SUMS).withColumn("hash_group", _hash_group()).groupBy("hash_group").transformWithStateInPandas(
        _HashKeys(), outputStructType=HASH_KEYS, outputMode="Append", timeMode="None", initialState=seeds)
    # A query copies the settings it is started under; state of this kind needs this store.
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return (
            keyed.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def enrich_stream(stream: DataFrame) -> DataFrame:
    """Standardised and quality columns on a stream; row by row, without state."""
    return with_quality(standardize(stream))
