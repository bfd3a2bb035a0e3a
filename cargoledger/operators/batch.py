"""Batch runs: file outcomes, job records and run statistics.

``job_files`` is keyed by (job_id, file_index) with filename, size, success and error; ``jobs`` has
one row per job with its counts, status and times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoledger import fixed_values as fv
from cargoledger.functions.files import check_file, file_type
from cargoledger.functions.numbers import money
from cargoledger.functions.text import strip
from cargoledger.operators.distribution import first_rows


def process_files(files: DataFrame, processed_at: Column) -> DataFrame:
    """File outcomes: refused files and files without a result carry an error, the rest metadata.

    ``files`` has job_id, file_index, filename, size, has_result and metodo_procesamiento.
    """
    check = check_file(F.col("filename"), F.col("size"))
    error = F.coalesce(check["error"], F.when(~F.col("has_result"), fv.FILE_NOT_PROCESSED))
    fine = F.col("error").isNull()
    return (
        files.withColumn("error", error)
        .withColumn("success", fine)
        .withColumn("archivo", F.when(fine, F.col("filename")))
        .withColumn("indice_archivo", F.when(fine, F.col("file_index")))
        .withColumn("tipo_archivo", F.when(fine, file_type(F.col("filename"))))
        .withColumn("fecha_procesamiento", F.when(fine, processed_at))
        .withColumn(
            "metodo_procesamiento", F.when(fine, F.coalesce("metodo_procesamiento", F.lit(fv.UNKNOWN_METHOD)))
        )
    )


def guard_batches(batches: DataFrame) -> DataFrame:
    """Batches with the reason they may not start, if any: ``name`` and ``n_files``."""
    reason = F.when(strip(F.coalesce("name", F.lit(""))) == "", "Debe ingresar un nombre para el lote").when(
        F.col("n_files") > fv.MAX_BATCH_FILES, "Máximo 50 archivos por lote"
    )
    return batches.withColumn("refused", reason).withColumn("accepted", reason.isNull())


def job_counts(job_files: DataFrame) -> DataFrame:
    """Counts per job from its file outcomes."""
    return job_files.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if("success").alias("processed_files"),
        F.count_if(~F.col("success")).alias("failed_files"),
    )


def job_results(job_files: DataFrame) -> DataFrame:
    """Successful files of every job, one row each, in the order of ``file_index``."""
    return job_files.where("success").select("job_id", "file_index", "filename")


def job_errors(job_files: DataFrame) -> DataFrame:
    """Failed files of every job with their error, one row each, in the order of ``file_index``."""
    return job_files.where("NOT success").select(
        "job_id", "file_index", "filename", F.coalesce("error", F.lit("Unknown error")).alias("error")
    )


def job_progress(jobs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Progress, success rate, files left and elapsed seconds per job."""
    done = F.col("processed_files") + F.col("failed_files")
    total = F.nullif(F.col("total_files"), F.lit(0))
    until = F.coalesce("end_time", as_of) if as_of is not None else F.col("end_time")
    return jobs.select(
        "job_id",
        F.coalesce(done / total * 100, F.lit(0.0)).alias("progress_percentage"),
        F.coalesce(F.col("processed_files") / total * 100, F.lit(0.0)).alias("success_rate"),
        (F.col("total_files") - done).alias("remaining"),
        seconds_between(F.col("start_time"), until).alias("elapsed_seconds"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return micros / 1e6


def finished_jobs(jobs: DataFrame) -> DataFrame:
    """Completed jobs with both times known."""
    return jobs.where((F.col("status") == "completed") & F.col("start_time").isNotNull() & F.col("end_time").isNotNull())


def jobs_with_status(jobs: DataFrame, status: str) -> DataFrame:
    return jobs.where(F.col("status") == status)


def batch_totals(jobs: DataFrame) -> DataFrame:
    """Totals over all jobs, success percentage and files per job."""
    sums = jobs.agg(
        F.count(F.lit(1)).alias("n_jobs"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("processed_files", "failed_files", "total_files")],
    )
    rate = F.col("processed_files") / F.nullif(F.col("total_files"), F.lit(0)) * 100
    per_job = F.col("total_files") / F.nullif(F.col("n_jobs"), F.lit(0))
    return sums.withColumn("success_rate", F.coalesce(rate, F.lit(0.0))).withColumn(
        "files_per_job", F.coalesce(per_job, F.lit(0.0))
    )


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def time_metrics(jobs: DataFrame) -> DataFrame:
    """Seconds per processed file and mean minutes per finished job; no finished job gives no row."""
    seconds = seconds_between(F.col("start_time"), F.col("end_time"))
    sums = finished_jobs(jobs).agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.sum(money(seconds)).cast("double").alias("total_seconds"),
        F.sum("processed_files").alias("processed"),
    )
    return sums.where("n_jobs > 0").select(
        "n_jobs",
        F.when(F.col("processed") > 0, F.col("total_seconds") / F.col("processed")).alias("seconds_per_file"),
        (F.col("total_seconds") / 60 / F.col("n_jobs")).alias("minutes_per_job"),
    )


def upload_summary(job_files: DataFrame) -> DataFrame:
    """Per batch: file count, megabytes, and the estimated minutes to process it."""
    n = F.col("n_files")
    return (
        job_files.groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("n_files"), (F.sum("size") / (1024 * 1024)).alias("total_mb"))
        .withColumn("minutes_low", n * fv.SECONDS_PER_FILE_LOW / 60)
        .withColumn("minutes_high", n * fv.SECONDS_PER_FILE_HIGH / 60)
    )


def first_with_rest(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each key and, on each of them, how many more there are.

    The shown rows are cut before the shuffle and the counts are pre-aggregated, so a long group
    costs no more than a short one.
    """
    shown = first_rows(rows, [key], [F.col(order)], n)
    counted = rows.groupBy(key).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("n_more"))
    return shown.join(counted, key)


def latest_first(jobs: DataFrame) -> DataFrame:
    """Jobs by start time, newest first, never-started ones last."""
    return jobs.orderBy(F.desc_nulls_last("start_time"), "job_id")
