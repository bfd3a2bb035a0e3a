"""Saved work sessions: append, load, change, and statistics.

Two tables as Parquet directories or DataFrames: ``work_sessions`` (one row per id) and
``session_documents`` (session_id, document_index). Changes return the new state of a table.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger import fixed_values as fv
from cargoledger.functions.text import display_name
from cargoledger.operators.distribution import SLICE_ROWS, balanced_join

METADATA = T.MapType(T.StringType(), T.StringType())


def _id(*parts: Column) -> Column:
    """Stable row id: a task that runs twice must write the same id."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def build_sessions(
    documents: DataFrame, saved_at: Column, status: str = "completed", slice_rows: int = SLICE_ROWS
) -> tuple[DataFrame, DataFrame]:
    """The two frames to append when working sets are saved.

    ``documents`` holds one row per document of a set: set_id, session_name, user_notes, document_index,
    bl_number, error, original_data and edited_data (JSON). Sets are told apart by set_id, so two of one
    name are two sessions; ids hash it with the time of the save, so a later save of the same set is a
    session of its own. A set with any edit counts no errors; otherwise it counts one if its first
    document failed.
    """
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    edited = F.col("edited_data").isNotNull()
    first_failed = F.coalesce(F.min_by(failed, "document_index"), F.lit(False))
    sets = documents.groupBy("set_id").agg(
        F.max("session_name").alias("session_name"),
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if(edited).alias("edited_count"),
        F.max("user_notes").alias("user_notes"),
        first_failed.alias("_first_failed"),
    )
    n_failed = F.when((F.col("edited_count") == 0) & F.col("_first_failed"), 1).otherwise(0).cast("bigint")
    sets = sets.withColumn("documents_with_errors", n_failed)
    metadata = F.to_json(
        F.struct(
            "total_documents",
            "documents_with_errors",
            "edited_count",
            F.date_format(saved_at, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
            F.lit(True).alias("processing_complete"),
            (F.col("edited_count") > 0).alias("validation_mode"),
            F.lit(True).alias("consolidated_flow"),
        )
    )
    when = F.date_format(saved_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    session_id = _id(F.lit("session"), F.col("set_id"), when)
    sessions = sets.select(
        session_id.alias("id"),
        "session_name",
        saved_at.alias("created_at"),
        saved_at.alias("updated_at"),
        F.coalesce("user_notes", F.lit("")).alias("user_notes"),
        "total_documents",
        "documents_with_errors",
        F.lit(status).alias("processing_status"),
        metadata.alias("session_data"),
    )
    counts = sets.select("set_id", "documents_with_errors")
    weights = sets.select("set_id", F.col("total_documents").alias("_rows"))
    rows = balanced_join(documents, counts, ["set_id"], ["document_index"], weights=weights, slice_rows=slice_rows)
    name = F.coalesce(
        "bl_number", F.concat(F.lit("Documento_"), (F.col("document_index") + 1).cast("string"))
    )
    saved = rows.select(
        _id(F.lit("document"), F.col("set_id"), when, F.col("document_index")).alias("id"),
        session_id.alias("session_id"),
        "document_index",
        name.alias("filename"),
        "original_data",
        "edited_data",
        F.when(edited, "edited").otherwise("original").alias("validation_status"),
        F.col("documents_with_errors").alias("error_count"),
        saved_at.alias("created_at"),
        saved_at.alias("updated_at"),
    )
    return sessions, saved


def append_sessions(sessions: DataFrame, documents: DataFrame, folder: str) -> None:
    """Append both frames below ``folder``.

    Documents go first: a reader that joins from sessions never meets a session without documents.
    """
    documents.write.mode("append").parquet(f"{folder}/session_documents")
    sessions.write.mode("append").parquet(f"{folder}/work_sessions")


def read_sessions(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/work_sessions"), spark.read.parquet(f"{folder}/session_documents")


# The list of published saves; a save is there for readers from the moment its row is.
SAVES = "save_id string, attempt string"


def _store(sessions: DataFrame, documents: DataFrame, folder: str) -> None:
    """Empty tables and an empty list of saves below ``folder``, unless they are there."""
    place = "save_id=save-none/attempt=try-none"
    documents.limit(0).write.mode("ignore").parquet(f"{folder}/session_documents/{place}")
    sessions.limit(0).write.mode("ignore").parquet(f"{folder}/work_sessions/{place}")
    sessions.sparkSession.createDataFrame([], SAVES).write.mode("ignore").parquet(f"{folder}/saves")


def _save_key(save_id: str) -> str:
    return "save-" + hashlib.md5(save_id.encode()).hexdigest()


def stage_sessions(sessions: DataFrame, documents: DataFrame, folder: str, save_id: str) -> str:
    """Write both frames of a save into folders of their own, which no reader looks at yet; returns the attempt's name."""
    _store(sessions, documents, folder)
    attempt = "try-" + uuid.uuid4().hex
    place = f"save_id={_save_key(save_id)}/attempt={attempt}"
    documents.write.parquet(f"{folder}/session_documents/{place}")
    sessions.write.parquet(f"{folder}/work_sessions/{place}")
    return attempt


def publish_save(spark: SparkSession, folder: str, save_id: str, attempt: str) -> None:
    """Make a staged save visible in both tables at once: one row, in one file, is added to the list of saves."""
    row = spark.createDataFrame([(_save_key(save_id), attempt)], SAVES)
    row.coalesce(1).write.mode("append").parquet(f"{folder}/saves")


def published_saves(spark: SparkSession, folder: str) -> DataFrame:
    """One attempt per published save; of several, which hold the same rows, the one with the smallest name."""
    return spark.read.schema(SAVES).parquet(f"{folder}/saves").groupBy("save_id").agg(F.min("attempt").alias("attempt"))


def save_sessions(sessions: DataFrame, documents: DataFrame, folder: str, save_id: str) -> bool:
    """Save both frames as one act; false if a save of that id is there already, which leaves the store as it is.

    A save that stops anywhere before its last step leaves files that no reader sees, and can simply be
    repeated under its id. Writers never change files of others, so they need no lock.
    """
    _store(sessions, documents, folder)
    spark = sessions.sparkSession
    if not published_saves(spark, folder).where(F.col("save_id") == _save_key(save_id)).isEmpty():
        return False
    publish_save(spark, folder, save_id, stage_sessions(sessions, documents, folder, save_id))
    return True


def saved_sessions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both tables as the published saves leave them; the list of saves prunes the folders that are read."""
    saves = published_saves(spark, folder)

    def visible(table: str) -> DataFrame:
        place = ["save_id", "attempt"]
        return spark.read.parquet(f"{folder}/{table}").join(saves, place, "left_semi").drop(*place)

    return visible("work_sessions"), visible("session_documents")


def is_json_object(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\s*\{"), F.lit(False))


def with_metadata(sessions: DataFrame) -> DataFrame:
    """Sessions with their JSON payload as a map; anything but an object gives an empty map."""
    empty = F.create_map().cast(METADATA)
    parsed = F.when(is_json_object(F.col("session_data")), F.from_json("session_data", METADATA))
    return sessions.withColumn("metadata", F.coalesce(parsed, empty)).drop("session_data")


def recent_list(sessions: DataFrame, limit: int = fv.SESSION_LIST_LIMIT) -> DataFrame:
    """The latest sessions, newest update first."""
    return with_metadata(sessions.orderBy(F.desc("updated_at"), "id").limit(limit))


def load_sessions(sessions: DataFrame, documents: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """What a session reopens with: the edit of its first document, else its original wrapped.

    ``ids`` restricts both tables before they are joined. Sessions without a document have no
    payload. Anything but a JSON object reads as empty.
    """
    if ids is not None:
        sessions, documents = sessions.where(F.col("id").isin(ids)), documents.where(F.col("session_id").isin(ids))
    first = documents.groupBy("session_id").agg(
        F.min_by(F.struct("edited_data", "original_data"), "document_index").alias("d")
    )
    edited, original = F.col("d.edited_data"), F.col("d.original_data")

    def as_object(c: Column) -> Column:
        return F.when(is_json_object(c), c).otherwise(F.lit("{}"))

    wrapped = F.concat(F.lit('{"bl_data": '), as_object(original), F.lit(', "all_invoices_data": []}'))
    payload = F.when(edited.isNotNull(), as_object(edited)).when(original.isNotNull(), wrapped)
    ids = sessions.select(F.col("id").alias("session_id"), "session_name")
    return ids.join(first, "session_id", "left").select("session_id", "session_name", payload.alias("payload"))


def delete_sessions(sessions: DataFrame, documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given ids (column ``id``) and the documents that belonged to them."""
    gone = ids.select("id").distinct()
    kept = sessions.join(gone, "id", "left_anti")
    doomed = gone.select(F.col("id").alias("session_id"))
    return kept, balanced_join(documents, doomed, ["session_id"], ["document_index"], how="left_anti")


def orphan_documents(sessions: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents whose session does not exist."""
    known = sessions.select(F.col("id").alias("session_id"))
    return balanced_join(documents, known, ["session_id"], ["document_index"], how="left_anti")


def update_notes(sessions: DataFrame, notes: DataFrame, changed_at: Column) -> DataFrame:
    """Sessions with new notes (``id, user_notes``) and the time of the change."""
    new = notes.select("id", F.col("user_notes").alias("_notes"), F.lit(True).alias("_changed"))
    return (
        sessions.join(new, "id", "left")
        .withColumn("user_notes", F.when(F.col("_changed"), F.col("_notes")).otherwise(F.col("user_notes")))
        .withColumn("updated_at", F.when(F.col("_changed"), changed_at).otherwise(F.col("updated_at")))
        .drop("_notes", "_changed")
    )


def created_since(sessions: DataFrame, as_of: Column, days: int = fv.RECENT_DAYS) -> DataFrame:
    return sessions.where(F.col("created_at") >= F.date_sub(as_of, days))


def statistics(sessions: DataFrame, as_of: Column, days: int = fv.RECENT_DAYS) -> DataFrame:
    """Counts, averages, last creation, recent sessions and error rate in one row."""
    recent = F.col("created_at") >= F.date_sub(as_of, days)
    sums = sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.coalesce(F.sum("total_documents"), F.lit(0)).alias("total_documents_processed"),
        F.coalesce(F.sum("documents_with_errors"), F.lit(0)).alias("total_documents_with_errors"),
        F.count("total_documents").alias("_counted"),
        F.max("created_at").alias("last_session_date"),
        F.count_if(recent).alias("recent_sessions"),
    )
    documents = F.col("total_documents_processed")
    return (
        sums.withColumn(
            "avg_documents_per_session", F.coalesce(documents / F.nullif(F.col("_counted"), F.lit(0)), F.lit(0.0))
        )
        .withColumn(
            "error_rate",
            F.coalesce(F.col("total_documents_with_errors") / F.nullif(documents, F.lit(0)) * 100, F.lit(0.0)),
        )
        .drop("_counted")
    )


def status_distribution(sessions: DataFrame) -> DataFrame:
    counted = sessions.groupBy("processing_status").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("name", display_name(F.col("processing_status"), fv.SESSION_STATUS_NAMES))
