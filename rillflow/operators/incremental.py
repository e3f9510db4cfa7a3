"""Processing only new or changed records.

Two layers share one rule, the anti-join of a *listing* (what exists now: identity, size, checksum) against a
*manifest* (what a successful run has covered: identity, size, checksum). What is pending is written into a directory named by a
batch identifier (overwritten when the same batch is tried again), and only then is the manifest committed, by a file that
only one run can create. A run that dies before the commit leaves nothing a reader sees.

* `FileManifest` does it for input files; `file_runs` drives it over a whole table: a first run, a change of the files, a second run, and
  one with nothing to do.
* `RecordManifest` does it for the records of a keyed log, per subscription; `offset_listing` says what is there and what the
  subscriptions' own reports cover.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.files import Files
from rillflow.functions.keys import json_content, plain_key, state_name
from rillflow.runtime import cut_lineage

LISTING = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.LongType()), T.StructField("listed", T.LongType()), T.StructField("checksum", T.StringType())])
#: A file that changed less than this before it was listed may change again under the same time: it is hashed at the next listing too.
RACY_MS = 2_000
#: Manifest files that are read one by one, before they are put together.
SNAPSHOT = 50
ENTRY = T.StructType([*LISTING.fields, T.StructField("batch_id", T.StringType()), T.StructField("seq", T.LongType())])


def pending(listing: DataFrame, manifest: DataFrame, identity: list[str], filled: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the listing whose identity, size and checksum the manifest doesn't hold.

    Nulls compare as equal values. `filled` names columns that never are null: a partitioning by these serves the join. Rows repeated in these come out once. Other columns of the listing are kept.
    """
    held = manifest.select(*[F.col(c).alias(f"__m_{c}") for c in (*identity, "size", "checksum")]).distinct()
    on = None
    for c in (*identity, "size", "checksum"):
        same = F.col(c) == F.col(f"__m_{c}") if c in filled else F.col(c).eqNullSafe(F.col(f"__m_{c}"))
        on = same if on is None else on & same
    return listing.dropDuplicates([*identity, "size", "checksum"]).join(held, on, "left_anti")


class FileManifest:
    """Manifest of processed input files under `root`, with output batches beside it.

    `run(listing, process)` calls `process(paths) -> DataFrame` with the new and changed files only. Layout:
    ``root/out/batch_id=.../`` (written first, idempotently), ``root/manifest/<seq>.json`` (committed last) and
    ``root/snapshots/<seq>`` (the entries of all commits before it, put together). Empty listings commit nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def listing(self, paths: list[str]) -> DataFrame:
        """Size, time of change and checksum of each data file below the paths. Only files whose path, size and time the manifest doesn't
        hold are read; these are hashed on the executors, in blocks, never whole in memory."""
        now = int(time.time() * 1000)
        found = [(*f, now) for p in paths for f in self.files.data_files(p)]
        spark = self.spark
        if not found:
            return spark.createDataFrame([], LISTING)
        there = spark.createDataFrame(found, "path string, size bigint, mtime bigint, listed bigint")
        held = self.entries().where(F.col("mtime") < F.col("listed") - RACY_MS).select("path", "size", "mtime", "checksum")
        both = there.join(held, ["path", "size", "mtime"], "left").select(*LISTING.names)
        n = max(1, min(len(found), spark.sparkContext.defaultParallelism * 4))
        return cut_lineage(both.where("checksum is not null").unionByName(both.where("checksum is null").repartition(n).mapInArrow(_hash_files, LISTING)))

    def entries(self) -> DataFrame:
        """The entry in force for each file: its newest commit."""
        done = self._committed()
        if not done:
            return self.spark.createDataFrame([], ENTRY)
        start = max((i for i, n in enumerate(done) if self.files.exists(f"{self.root}/snapshots/{n[:-5]}/_SUCCESS")), default=0)
        rows = self.spark.read.schema(ENTRY).json([f"{self.root}/manifest/{n}" for n in done[start:]])
        if start:
            rows = rows.unionByName(self.spark.read.schema(ENTRY).parquet(f"{self.root}/snapshots/{done[start][:-5]}"))
        return rows.groupBy("path").agg(F.max_by(F.struct(*LISTING.names[1:], "batch_id", "seq"), "seq").alias("e")).select("path", "e.*")

    def _committed(self) -> list[str]:
        return [n for n in self.files.names(f"{self.root}/manifest") if n.endswith(".json")]

    def run(self, listing: DataFrame, process: Callable[[list[str]], DataFrame]) -> str | None:
        """Process what is new or changed; the batch identifier, or None if there was nothing to do."""
        held = self.entries()
        todo = [r.asDict() for r in pending(listing, held, ["path"]).collect()]  # one row a file, not a record
        if not todo:
            return None
        todo.sort(key=lambda r: (r["path"], r["checksum"]))
        seq = len(self._committed())
        batch = hashlib.sha256(json.dumps([seq, [[r["path"], r["size"], r["checksum"]] for r in todo]]).encode()).hexdigest()[:16]
        process([r["path"] for r in todo]).write.mode("overwrite").parquet(f"{self.root}/out/batch_id={batch}")
        if seq and seq % SNAPSHOT == 0:  # entries of the commits before; counts only once this commit is there
            held.write.mode("overwrite").parquet(f"{self.root}/snapshots/{seq:012d}")
        self._commit(seq, batch, todo)
        return batch

    def _commit(self, seq: int, batch: str, todo: list[dict]) -> None:
        text = "".join(json.dumps(r | {"batch_id": batch, "seq": seq}) + "\n" for r in todo)
        if not self.files.put_new(f"{self.root}/manifest/{seq:012d}.json", text):
            raise RuntimeError(f"another run has committed number {seq}")

    def read(self, source_file_column: str | None = None) -> DataFrame | None:
        """Rows of committed batches. With a source file column, rows of a file's older version are left out."""
        entries = self.entries()
        batches = [r.batch_id for r in entries.select("batch_id").distinct().collect()]
        if not batches:
            return None
        rows = self.spark.read.option("basePath", f"{self.root}/out").option("mergeSchema", "true").parquet(*[f"{self.root}/out/batch_id={b}" for b in batches])
        rows = rows.withColumn("batch_id", F.col("batch_id").cast("string"))
        if source_file_column is None:
            return rows
        bare = lambda c: F.regexp_replace(F.col(c), "^file:/+", "file:/")
        live = entries.select(bare("path").alias("__path"), F.col("batch_id").alias("__batch"))
        return rows.join(live, (bare(source_file_column) == F.col("__path")) & (F.col("batch_id") == F.col("__batch")), "left_semi")


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash
    from pyarrow import fs

    for batch in batches:
        sums = []
        for path in batch.column(0).to_pylist():
            store, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
            h = xxhash.xxh3_128()
            with store.open_input_stream(at) as f:
                while block := f.read(1 << 22):
                    h.update(block)
            sums.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.string())], names=LISTING.names)


_DAY_US = 86_400_000_000


def _put_days(df: DataFrame, folder: str) -> None:
    """One file for each value of `day`, under a name of its own; a file of that name is replaced."""
    spark = df.sparkSession
    path, temp = spark._jvm.org.apache.hadoop.fs.Path, f"{folder}.{uuid.uuid4().hex}"
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    df.repartition("day").write.partitionBy("day").parquet(temp)
    for at in fs.listStatus(path(temp)):
        if at.isDirectory():
            files = [f.getPath() for f in fs.listStatus(at.getPath())]
            if len(files) != 1:
                raise RuntimeError(f"{len(files)} files for {at.getPath().getName()}")
            final = path(f"{folder}/{at.getPath().getName().replace('=', '')}.parquet")
            fs.delete(final, False)
            if not fs.rename(files[0], final):
                raise RuntimeError(f"could not put {final}")
    fs.delete(path(temp), True)


def file_runs(records: DataFrame, at: str, root: str) -> DataFrame | None:
    """The records, with `run` (1 or 2): the run of a `FileManifest` under `root` that processed the file they lie in now.

    The records are laid into files by the day of `at` (those without a time into one more). Run 1 sees what had arrived by
    the middle of the whole time. Then the rest arrives: the file of a day that was cut in two changes, later days come as new
    files. Run 2 processes those alone, and a third run must find nothing. Of a changed file only the newer version counts, so every
    record comes out once. None for an empty table. The rows are read from `root` when they are asked for.
    """
    spark = records.sparkSession
    us = F.unix_micros(F.col(at).cast("timestamp"))
    low, high = records.agg(F.min(us), F.max(us)).first()
    cut = None if low is None else low + (high - low) // 2
    rest = None if cut is None else records.where(us > cut).agg(F.min(us)).first()[0]
    days = records.withColumn("day", F.coalesce(F.floor(us / _DAY_US), F.lit(-1)))
    manifest, folder = FileManifest(spark, f"{root}/state"), f"{root}/in"
    process = lambda paths: spark.read.schema(records.schema).parquet(*paths).withColumn("_file", F.input_file_name())
    _put_days(days.where(us.isNull() | (us <= F.lit(cut).cast("bigint"))), folder)
    manifest.run(manifest.listing([folder]), process)
    if rest is not None:
        _put_days(days.where(F.col("day") >= rest // _DAY_US), folder)
        manifest.run(manifest.listing([folder]), process)
    if manifest.run(manifest.listing([folder]), process) is not None:
        raise RuntimeError("a run without a change found files to process")
    rows = manifest.read("_file")
    if rows is None:
        return None
    runs = manifest.entries().select("batch_id", (F.col("seq") + 1).alias("run")).distinct()
    return rows.join(F.broadcast(runs), "batch_id").select(*records.columns, "run")


#: Offsets of a key are joined in stretches of 2 ** STRETCH_BITS, so that the largest key spreads over many tasks; beyond the first
#: 2 ** FAR_BITS offsets, each further doubling is cut into 2 ** 16 stretches, so that a wild bound opens few.
STRETCH_BITS, FAR_BITS = 14, 34


def stretch_of_offset(offset: str) -> Column:
    """Number of the stretch an offset lies in; it rises with the offset."""
    near = 1 << (FAR_BITS - STRETCH_BITS)
    return F.expr(
        f"case when {offset} < 0 then 0L when {offset} < {1 << FAR_BITS}L then shiftright({offset}, {STRETCH_BITS}) "
        f"else {near}L + (length(bin({offset})) - 1 - {FAR_BITS}) * 65536L + shiftright({offset} - shiftleft(1L, length(bin({offset})) - 1), length(bin({offset})) - 17) end"
    )


RECORD = ("subscription_id", "stream_name", "partition_id", "record_offset")


def offset_listing(records: DataFrame, snapshots: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listing and manifest of the records each subscription is to process: RECORD, stretch, size, checksum.

    The listing is each stored record between the subscription's first offset and its greatest reported one, in its newest
    form (size and checksum of its canonical content). The manifest is what reports say was processed: each record up to the
    watermark, in the newest form it had at the last success.

    Rows without stream, key or offset are no records. A subscription without any snapshot lists nothing, nor does one without an
    upper bound; without a watermark, or without a last success, or where a record came after it, the manifest has no
    entry. Of one `write_no` stored with several contents the greatest counts. Repeated rows change nothing.

    The records are moved once, by (stream, key, stretch of offsets): no task holds a whole key, however large, and all that
    follows, the anti-join of the two included, stays in that partitioning.
    """
    key = ["stream_name", "partition_id"]
    content = json_content("data")
    rec = (
        records.select("stream_name", plain_key("partition_id").alias("partition_id"), "record_offset", F.coalesce("write_no", F.lit(0)).alias("write_no"), F.octet_length(content).alias("size"), F.xxhash64(content).alias("checksum"), "arrived_at")
        .where("stream_name is not null and partition_id is not null and record_offset is not null")
        .withColumn("stretch", stretch_of_offset("record_offset"))
        .repartition(*key, "stretch")
    )
    versions = rec.groupBy(*key, "stretch", "record_offset", "write_no").agg(F.max(F.struct("size", "checksum")).alias("form"), F.min("arrived_at").alias("arrived_at"))
    held = ["subscription_id", *key]
    snap = snapshots.withColumn("partition_id", plain_key("partition_id")).groupBy(*held).agg(
        F.coalesce(F.min("first_offset"), F.lit(0)).alias("first"), F.max("range_end").alias("end_a"), F.max("committed").alias("committed"), F.max("committed_at").alias("committed_at")
    )
    done = (state_name("run_state") == "done") & F.col("last_completed_offset").isNotNull()
    ran = runs.withColumn("partition_id", plain_key("offset_key")).groupBy(*held).agg(
        F.max("max_offset").alias("end_b"), F.max(F.when(done, F.col("last_completed_offset"))).alias("completed"), F.max(F.when(done, F.col("finished_at"))).alias("finished_at")
    )
    ran = ran.select(*[F.col(c).alias(f"r_{c}") for c in held], "end_b", "completed", "finished_at")
    on = F.lit(True)
    for c in held:
        on = on & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    state = snap.join(ran, on, "left").select(
        *held, "first", F.greatest("end_a", "end_b").alias("last"), F.greatest(F.col("committed") - 1, "completed").alias("watermark"), F.greatest("committed_at", "finished_at").alias("success")
    )
    wanted = state.where("first <= last").withColumn("stretch", F.explode(F.sequence(stretch_of_offset("first"), stretch_of_offset("last"))))
    both = versions.join(wanted, [*key, "stretch"]).where(F.col("record_offset").between(F.col("first"), F.col("last")))
    covered = (F.col("record_offset") <= F.col("watermark")) & (F.col("arrived_at") <= F.col("success"))
    # Both read the same columns, so that the records are moved once for the two.
    newest = lambda df: df.groupBy(*RECORD, "stretch").agg(F.max_by(F.struct("form", "arrived_at"), "write_no").alias("v")).select(*RECORD, "stretch", "v.form.*")
    return newest(both), newest(both.where(covered))


class RecordManifest:
    """Runs over records: what is listed and not covered is written as a batch, then the batch is committed.

    ``root/out/batch_id=.../`` holds the batches, ``root/manifest/<seq>.json`` says which of them count. What committed batches hold is
    covered, beside the manifest given to a run; of a record in several, the newest counts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def batches(self) -> list[str]:
        return [json.loads(self.files.read(f"{self.root}/manifest/{n}"))["batch_id"] for n in self.files.names(f"{self.root}/manifest")]

    def run(self, listing: DataFrame, manifest: DataFrame) -> str | None:
        """Write and commit what is pending; the batch's identifier, or None if nothing is.

        The identifier is made of the run's number and the files the listing is read from, so a run tried again writes over what
        it left. Of runs racing for a number one commits.
        """
        done = self.batches()
        for i, b in enumerate(done):
            rows = self.read(b).withColumn("seq", F.lit(i))
            manifest = (manifest.withColumn("seq", F.lit(-1)) if i == 0 else manifest).unionByName(rows)
        if done:
            manifest = manifest.groupBy(*RECORD, "stretch").agg(F.max_by(F.struct("size", "checksum"), "seq").alias("form")).select(*RECORD, "stretch", "form.*")
        batch = hashlib.sha256(json.dumps([len(done), sorted(listing.inputFiles())]).encode()).hexdigest()[:16]
        at = f"{self.root}/out/batch_id={batch}"
        co = "spark.sql.requireAllClusterKeysForCoPartition"
        conf = self.spark.conf
        before = conf.get(co)
        try:
            conf.set(co, "false")  # both sides already lie by (stream, key, stretch), a part of the identity
            pending(listing, manifest, [*RECORD, "stretch"], (*RECORD[1:], "stretch")).write.mode("overwrite").parquet(at)
        finally:
            conf.set(co, before)
        if self.read(batch).limit(1).count() == 0:
            self.files.delete(at)
            return None
        self._commit(len(done), batch)
        return batch

    def _commit(self, seq: int, batch: str) -> None:
        if not self.files.put_new(f"{self.root}/manifest/{seq:012d}.json", json.dumps({"batch_id": batch})):
            raise RuntimeError(f"another run has committed number {seq}")

    def read(self, batch: str | None) -> DataFrame:
        """RECORD, stretch, size and checksum of a batch (of none: no rows)."""
        schema = "subscription_id string, stream_name string, partition_id string, record_offset bigint, stretch bigint, size int, checksum bigint"
        return self.spark.createDataFrame([], schema) if batch is None else self.spark.read.schema(schema).parquet(f"{self.root}/out/batch_id={batch}")
