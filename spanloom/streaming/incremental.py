"""Windows kept up to date by what a micro-batch changes.

The newest version of every trace is kept in the log ``trace_versions``, one small row per contribution; a micro-batch reads those of its
own traces. A new version gives signed changes: what the old version added is taken back, what the new one adds is put in. All of
that is joins and sums, with no step per trace in Python. Three logs follow from the changes:

* ``window_changes``: the changes themselves, divided by the date of the slice they belong to;
* ``signature_slices``: measures per (slice, signature), one new row for each one that changed. Additions are folded into the row
  before. Where something is taken back, extremes cannot be folded, and sums of floating point numbers would drift; such
  a slice and signature is added up anew from its changes, of which only the dates concerned are read;
* ``analytics_windows``: one new row for each window that holds a changed slice. If a window size's baseline (its earliest window)
  changes, all windows are written again, as all compare with it.

All are append-only logs of batches: a replayed batch is written again as it was, and readers always find the newest
row of each key. Windows and slices that hold no trace any more keep a row with a count of 0, which readers leave out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import schemas
from spanloom.functions.timeparts import ingestion_date, ingestion_hour
from spanloom.operators import windows
from spanloom.options import DRIFT, DriftOptions
from spanloom.sources import changelog

_CONTRIBUTION = ["slice_ms", "signature", "q", "h", "c", "l", "d"]
_CHANGES = "slice_ms BIGINT, signature STRING, q DOUBLE, h DOUBLE, c DOUBLE, l DOUBLE, d BIGINT, sign INT"
_SLICE = ["slice_ms", "signature"]


# What the newest version of each trace adds. A trace that counts nowhere has a row with a null slice.
_VERSIONS = "trace_id STRING, version BIGINT, slice_ms BIGINT, signature STRING, q DOUBLE, h DOUBLE, c DOUBLE, l DOUBLE, d BIGINT"


def _newest(rows: DataFrame) -> DataFrame:
    """The rows of each trace's newest version."""
    newest = rows.groupBy(F.col("trace_id").alias("_trace")).agg(F.max("version").alias("_newest"))
    same = F.col("trace_id").eqNullSafe(F.col("_trace")) & (F.col("version") == F.col("_newest"))
    return rows.join(newest, same, "left_semi")


def _with_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``_known``, the version a trace had before, or null."""
    versions = known.groupBy(F.col("trace_id").alias("_trace")).agg(F.max("version").alias("_known"))
    return rows.join(versions, F.col("trace_id").eqNullSafe(F.col("_trace")), "left").drop("_trace")


def changes(correlated: DataFrame, folder: str, batch_id: int, options: DriftOptions = DRIFT) -> DataFrame:
    """A micro-batch of correlated rows (with batch numbers) as signed changes from the newest versions before it.

    A trace that counts nowhere has a null slice. Versions that are not newer than what is known change nothing.
    """
    spark = correlated.sparkSession
    numbers = [F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in "qhcl"]
    rows = correlated.select("trace_id", F.col(changelog.BATCH).alias("version"), *windows.contribution(options))
    batch = changelog.once(rows.select("trace_id", "version", "slice_ms", "signature", *numbers, "d"), f"{folder}/scratch/window_rows")
    log = changelog.read_log(spark, f"{folder}/trace_versions", _VERSIONS).where(F.col(changelog.BATCH) < batch_id)
    touched = batch.select(F.col("trace_id").alias("_trace")).distinct()
    before = log.drop(changelog.BATCH).join(touched, F.col("trace_id").eqNullSafe(F.col("_trace")), "left_semi")
    known = changelog.once(_newest(before), f"{folder}/scratch/known_versions")
    newer = _with_known(_newest(batch), known).where("_known IS NULL OR version > _known").drop("_known")
    changelog.write_batch(newer, f"{folder}/trace_versions", batch_id)
    new = changelog.read_log(spark, f"{folder}/trace_versions", _VERSIONS).where(F.col(changelog.BATCH) == batch_id).drop(changelog.BATCH)
    fresh = new.select(F.col("trace_id").alias("_trace")).distinct()
    old = known.join(fresh, F.col("trace_id").eqNullSafe(F.col("_trace")), "left_semi")
    both = new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1))).where("slice_ms IS NOT NULL")
    moved = both.groupBy("trace_id", *_CONTRIBUTION).agg(F.sum("sign").alias("_n")).where("_n <> 0")
    copies = F.explode(F.array_repeat(F.signum("_n").cast("int"), F.abs("_n").cast("int")))
    return moved.select(*_CONTRIBUTION, copies.alias("sign"))


def _dated(rows: DataFrame, at: str = "slice_ms") -> DataFrame:
    return rows.withColumns({"ingestion_date": ingestion_date(F.col(at)), "ingestion_hour": ingestion_hour(F.col(at))})


def _log(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return changelog.read_log(spark, f"{folder}/{table}", schemas.TABLES[table][0])


def _of(log: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of some slices and signatures. The dates come first: they are folders, so other dates are not read."""
    dates = touched.select("ingestion_date").distinct()
    return log.join(dates, "ingestion_date", "left_semi").join(touched.select(*_SLICE), _SLICE, "left_semi")


def write_changes(signed: DataFrame, folder: str, batch_id: int) -> None:
    changelog.write_batch(_dated(signed), f"{folder}/window_changes", batch_id)


def fold_changes(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """Writes the new rows of ``signature_slices`` for one written batch of changes; returns the slices and dates touched."""
    log = _log(spark, folder, "window_changes")
    batch = log.where(F.col(changelog.BATCH) == batch_id)
    touched = changelog.once(batch.groupBy(*_SLICE, "ingestion_date").agg((F.min("sign") < 0).alias("redo")), f"{folder}/scratch/touched_slices")
    more, again = touched.where(~F.col("redo")), touched.where("redo")
    before = _of(_log(spark, folder, "signature_slices").where(F.col(changelog.BATCH) < batch_id), more)
    before = changelog.current(before, _SLICE).where("n > 0").drop("ingestion_date", "ingestion_hour")
    put_in = batch.join(more.select(*_SLICE), _SLICE, "left_semi")
    grown = windows.added(before.unionByName(windows.sliced(put_in.select(*_CONTRIBUTION))))
    # Changes that cancel out leave nothing; equal contributions of several traces count several times.
    left = _of(log.where(F.col(changelog.BATCH) <= batch_id), again).groupBy(*_CONTRIBUTION).agg(F.sum("sign").cast("int").alias("copies"))
    left = left.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*_CONTRIBUTION)
    redone = again.select(*_SLICE).join(windows.sliced(left), _SLICE, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    changelog.write_batch(_dated(grown.unionByName(redone)), f"{folder}/signature_slices", batch_id, _SLICE)
    return touched.select("slice_ms", "ingestion_date").distinct()


def _starts(slices: DataFrame, options: DriftOptions) -> DataFrame:
    """The windows that hold some slices."""
    sizes = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(ms).cast("bigint").alias("ms")) for label, ms in options.window_sizes])
    start = F.col("slice_ms") - F.pmod(F.col("slice_ms"), F.col("_size.ms"))
    return slices.withColumn("_size", F.explode(sizes)).select(F.col("_size.label").alias("window_size"), start.alias("window_start_ms")).distinct()


def _rows_of(windows_: DataFrame, starts: DataFrame) -> DataFrame:
    return windows_.join(starts, ["window_size", "window_start_ms"], "left_semi")


def write_windows(spark: SparkSession, folder: str, batch_id: int, touched: DataFrame, options: DriftOptions = DRIFT) -> None:
    """Writes the windows that hold touched slices, or all if a baseline is among them."""
    log = _log(spark, folder, "signature_slices").where(F.col(changelog.BATCH) <= batch_id)
    known = changelog.current(_log(spark, folder, "analytics_windows").where(F.col(changelog.BATCH) < batch_id), windows.WINDOW)
    starts = changelog.once(_starts(touched, options), f"{folder}/scratch/touched_windows")
    # Two numbers per window size: the earliest window there was, and the earliest that changes.
    was = {r["window_size"]: r["t"] for r in known.where("trace_count > 0").groupBy("window_size").agg(F.min("window_start_ms").alias("t")).collect()}
    now = {r["window_size"]: r["t"] for r in starts.groupBy("window_size").agg(F.min("window_start_ms").alias("t")).collect()}
    if any(size not in was or first <= was[size] for size, first in now.items()):
        slices = changelog.current(log, _SLICE).where("n > 0")
        starts = starts.union(known.select("window_size", "window_start_ms")).distinct()
        rows = windows.drift_of(windows.sized_distribution(slices, options), options)
    else:
        # Slices of the windows to write and of the baselines, which stay the earliest.
        width = max(ms for _, ms in options.window_sizes)
        wide = (F.col("slice_ms") - F.pmod(F.col("slice_ms"), F.lit(width))).alias("wide_ms")
        firsts = spark.createDataFrame([(t - t % width,) for t in was.values()], "wide_ms BIGINT")
        needed = touched.select(wide).union(firsts).distinct().withColumn("ingestion_date", ingestion_date(F.col("wide_ms")))
        dates = needed.select("ingestion_date").distinct()
        near = log.join(dates, "ingestion_date", "left_semi").withColumn("wide_ms", F.col("slice_ms") - F.pmod(F.col("slice_ms"), F.lit(width)))
        slices = changelog.current(near.join(needed.select("wide_ms"), "wide_ms", "left_semi").drop("wide_ms"), _SLICE).where("n > 0")
        baseline = F.lit(False)
        for size, first in was.items():
            baseline |= (F.col("window_size") == size) & (F.col("window_start_ms") == first)
        sized = windows.sized_distribution(slices, options)
        marks = starts.withColumn("_wanted", F.lit(True))
        sized = sized.join(marks, windows.WINDOW, "left").where(F.col("_wanted") | baseline).drop("_wanted")
        rows = _rows_of(windows.drift_of(sized, options), starts)
    gone = starts.join(rows.select(*windows.WINDOW), windows.WINDOW, "left_anti").withColumn("trace_count", F.lit(0))
    changelog.write_batch(rows.unionByName(gone, allowMissingColumns=True), f"{folder}/analytics_windows", batch_id, windows.WINDOW)


def current_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The window table as it stands."""
    return changelog.current(_log(spark, folder, "analytics_windows"), windows.WINDOW).where("trace_count > 0")


def update(signed: DataFrame, folder: str, batch_id: int, options: DriftOptions = DRIFT) -> None:
    """One micro-batch of changes into the three logs. The changes are computed once."""
    spark = signed.sparkSession
    write_changes(signed, folder, batch_id)
    batch = _log(spark, folder, "window_changes").where(F.col(changelog.BATCH) == batch_id)
    if not batch.isEmpty():
        write_windows(spark, folder, batch_id, fold_changes(spark, folder, batch_id), options)
