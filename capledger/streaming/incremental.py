"""A lock kept up by a stream: every micro-batch of file rows folds into the last state of the bundles it touches, and tells what changed."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.operators import state
from capledger.sources.tables import scratch


def upsert(before: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files after a batch, changes of the touched bundles). Rows: root, path, sha256, terms; a path seen again replaces the old one."""
    kept = before.join(batch.select("root", "path"), ["root", "path"], "left_anti")
    after = kept.unionByName(batch)

    def lock(files: DataFrame) -> DataFrame:
        own = files.join(batch.select("root").distinct(), "root", "left_semi")
        caps = own.select("root", F.explode("terms").alias("term"))
        return state.build_lock(state.content_digest(own, "root"), caps)

    return after, state.diff_locks(lock(before), lock(after))


#: So many batches are read one by one before their rows are put together.
COMPACT = 16


def _latest(rows: DataFrame) -> DataFrame:
    """The last row of each path: of the last batch, and within it of the greatest ordinal."""
    rest = [c for c in rows.columns if c not in ("root", "path", "batch")]
    last = rows.groupBy("root", "path").agg(F.max_by(F.struct(*rest), F.struct("batch", "ordinal")).alias("x"))
    return last.select("root", "path", "x.*")


def last_state(spark: SparkSession, folder: str, before: int) -> DataFrame | None:
    """The files state after all batches under ``before``; None without any."""
    base = max((n for n in range(0, before + 1) if n % COMPACT == 0 and n and _there(spark, f"{folder}/base-{n}")), default=None)
    parts = [] if base is None else [spark.read.parquet(f"{folder}/base-{base}").withColumn("batch", F.lit(-1))]
    parts += [spark.read.parquet(f"{folder}/rows-{n}").withColumn("batch", F.lit(n)) for n in range(base or 0, before) if _there(spark, f"{folder}/rows-{n}")]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _latest(out)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path + "/_SUCCESS")
    return fs.exists(p)


def follow(stream: DataFrame, folder: str, now: bool = True):
    """Start the query. Rows: root, path, sha256, terms and, if a batch may hold a path twice, ordinal: the greatest wins.

    A batch writes its own rows to ``folder`` and the changes of the bundles it touches; the state is the last row of each path over all batches, put together
    every COMPACT batches, after which older rows are removed. So a batch costs what it touches, not what there has been. A batch that is run again overwrites its own tables, so that its effect is once.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        rows = batch if "ordinal" in batch.columns else batch.withColumn("ordinal", F.lit(0).cast("long"))
        _latest(rows.withColumn("batch", F.lit(n))).write.mode("overwrite").parquet(f"{folder}/rows-{n}")
        own = spark.read.parquet(f"{folder}/rows-{n}")
        state_ = last_state(spark, folder, n)
        before = spark.createDataFrame([], own.schema) if state_ is None else state_.join(own.select("root").distinct(), "root", "left_semi")
        _, changes = upsert(before, own)
        changes.write.mode("overwrite").parquet(f"{folder}/changes-{n}")
        if (n + 1) % COMPACT == 0:
            last_state(spark, folder, n + 1).write.mode("overwrite").parquet(f"{folder}/base-{n + 1}")
            for k in range(n + 1 - 2 * COMPACT, n + 1 - COMPACT):  # those before the last base are kept until the next, for a batch that is run again
                if k >= 0:
                    for name in (f"rows-{k}", f"base-{k}"):
                        p, fs = _path(spark, f"{folder}/{name}")
                        fs.delete(p, True)

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    return (w.trigger(availableNow=True) if now else w).start()


def batches(spark: SparkSession, folder: str) -> int:
    """How many batches there have been."""
    p, fs = _path(spark, folder)
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return 1 + max((int(x.removeprefix("rows-").removeprefix("base-")) - x.startswith("base-") for x in names if x.startswith(("rows-", "base-"))), default=-1)


def run_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, content_digest) of users after a stream over the events file: each event is a file row of its user, named by its type, the last event of a type being the file's content."""
    path = os.path.join(sf_dir, "events.parquet")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = scratch(spark, "stream")
    rows = stream.select(F.col("user_id").cast("string").alias("root"), F.col("event_type").alias("path"), F.sha2(F.col("event_id").cast("string"), 256).alias("sha256"), F.array().cast("array<string>").alias("terms"), F.col("event_id").cast("long").alias("ordinal"))
    follow(rows, folder).awaitTermination()
    return state.content_digest(last_state(spark, folder, batches(spark, folder)), "root")
