"""Append ledgers as Structured Streaming jobs. Each has a batch function of the same result.

The state is a table of one row per key in buckets. A batch reads the buckets of its keys as they were after
the batch before and writes them under its epoch, with a list of every bucket's version, so that a batch
that is run again writes the same rows again, and what a batch does not touch is not written anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import strip

SUFFIXES = (".md", ".txt", ".yml", ".yaml", ".json", ".sql", ".csv", ".xlsx")


def last_hashes(events: DataFrame) -> DataFrame:
    """(path, hash, seq, changes): the last content of every design file and how often it changed."""
    ok = events.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$"))
    w = Window.partitionBy("path").orderBy("seq")
    moved = ok.withColumn("_c", (~F.col("hash").eqNullSafe(F.lag("hash").over(w))).cast("int"))
    return moved.groupBy("path").agg(F.max_by("hash", "seq").alias("hash"), F.max("seq").alias("seq"), F.sum("_c").alias("changes"))


def _merge_hashes(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Fold a batch into R1's state; the state is the event before the first of the batch."""
    old = state.select("path", "hash", "seq").withColumn("_old", F.lit(True))
    both = old.unionByName(batch.select("path", "hash", "seq").withColumn("_old", F.lit(False)))
    new = last_hashes(both.select("path", "hash", "seq"))
    j = new.join(state.select("path", F.col("changes").alias("_before")), "path", "left")
    return j.withColumn("changes", F.when(F.col("_before").isNull(), F.col("changes")).otherwise(F.col("_before") + F.col("changes") - 1)).drop("_before")


# Fixed value: the longest key of a mutation.
MAX_KEY = 200


def _keyed(events: DataFrame) -> DataFrame:
    """Events with their trimmed key (null: none, or too long) and a digest of action and params.

    Params are JSON: order of names and white space do not count. What is no JSON counts as text.
    """
    key = strip(F.coalesce("key", F.lit("")))
    params = F.coalesce(F.to_json(F.try_parse_json("params")), F.col("params"))
    digest = F.sha2(F.to_json(F.struct("action", params.alias("params"))), 256)
    return events.withColumn("_k", F.when(F.length(key).between(1, MAX_KEY), key)).withColumn("_d", digest)


def first_mutations(events: DataFrame) -> DataFrame:
    """R2: (key, action, digest, seq): the first mutation of each valid key."""
    d = _keyed(events).where("_k is not null")
    return d.groupBy(F.col("_k").alias("key")).agg(F.min_by(F.struct("action", F.col("_d").alias("digest"), "seq"), "seq").alias("f")).select("key", "f.action", "f.digest", "f.seq")


def mutation_results(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """R2: each event against the ledger: applied (the first), replayed (same content), conflict (other content) or invalid (its key)."""
    j = _keyed(events).join(ledger.select(F.col("key").alias("_k"), F.col("digest").alias("_f"), F.col("seq").alias("_s")), "_k", "left")
    out = F.when(F.col("_k").isNull(), "invalid").when(F.col("seq") == F.col("_s"), "applied").when(F.col("_d") == F.col("_f"), "replayed").otherwise("conflict")
    return j.withColumn("outcome", out).select(*events.columns, "outcome")


def _merge_mutations(state: DataFrame, batch: DataFrame) -> DataFrame:
    new = first_mutations(batch).join(state.select("key"), "key", "left_anti")
    return state.unionByName(new.select(state.columns))


def current_status(decisions: DataFrame) -> DataFrame:
    """(impact_id, status, seq): the last status of each impact."""
    return decisions.groupBy("impact_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def _merge_status(state: DataFrame, batch: DataFrame) -> DataFrame:
    return current_status(state.select("impact_id", "status", "seq").unionByName(batch.select("impact_id", "status", "seq")))


#: By ledger: the schema of its state (the first column is the key), the key of an event, and how a batch is folded in.
LEDGERS: dict[str, tuple[str, Callable[[], Column], Callable[[DataFrame, DataFrame], DataFrame]]] = {
    "source_changes": ("path string, hash string, seq long, changes long", lambda: F.col("path"), _merge_hashes),
    "mutations": ("key string, action string, digest string, seq long", lambda: strip(F.coalesce("key", F.lit(""))), _merge_mutations),
    "decisions": ("impact_id string, status string, seq long", lambda: F.col("impact_id"), _merge_status),
}


def _versions(spark: SparkSession, place: str, epoch: int) -> dict[int, int]:
    """Version of every bucket that has one after a batch; at most as many as there are buckets."""
    if epoch < 0:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{place}/buckets/v{epoch}").collect()}


def _state(spark: SparkSession, place: str, schema: str, versions: dict[int, int]) -> DataFrame:
    paths = [f"{place}/rows/v{v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def run(stream: DataFrame, ledger: str, folder: str, buckets: int = 64) -> StreamingQuery:
    """Fold a stream into a ledger under `folder`; ends when what is available is read. Only buckets of keys that a batch holds are written anew."""
    schema, key, merge = LEDGERS[ledger]
    spark, place = stream.sparkSession, f"{folder}/{ledger}"
    bucket = lambda k: F.pmod(F.xxhash64(k), F.lit(buckets)).cast("int").alias("bucket")

    def fold(batch: DataFrame, epoch: int) -> None:
        known = _versions(spark, place, epoch - 1)
        touched = {r["bucket"] for r in batch.select(bucket(key())).distinct().collect()}
        old = _state(spark, place, schema, {b: v for b, v in known.items() if b in touched})
        new = merge(old, batch)
        new.withColumn("bucket", bucket(F.col(new.columns[0]))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{place}/rows/v{epoch}")
        written = {r["bucket"] for r in spark.read.parquet(f"{place}/rows/v{epoch}").select("bucket").distinct().collect()} if touched else set()
        rows = [(b, v) for b, v in {**known, **dict.fromkeys(written, epoch)}.items()]
        spark.createDataFrame(rows, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{place}/buckets/v{epoch}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start()


def latest(spark: SparkSession, ledger: str, folder: str, epoch: int) -> DataFrame:
    """A ledger's state after a batch."""
    place = f"{folder}/{ledger}"
    return _state(spark, place, LEDGERS[ledger][0], _versions(spark, place, epoch))
