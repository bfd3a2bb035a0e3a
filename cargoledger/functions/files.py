"""Checks on file names and sizes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargoledger import fixed_values as fv
from cargoledger.functions.numbers import python_fixed

KIB = 1024
MIB = 1024 * 1024


def size_label(size: Column) -> Column:
    return (
        F.when(size < KIB, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < MIB, F.concat(python_fixed(size / KIB, 1), F.lit(" KB")))
        .otherwise(F.concat(python_fixed(size / MIB, 1), F.lit(" MB")))
    )


def file_type(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".pdf"), "pdf").otherwise("image")


def check_file(name: Column, size: Column) -> Column:
    """struct(valid, type, size, error); the size limit is tested before the extension."""
    extensions = "|".join(e[1:] for e in fv.ALLOWED_EXTENSIONS)
    error = F.when(size > fv.MAX_FILE_BYTES, F.format_string(fv.FILE_TOO_LARGE, size_label(size))).when(
        ~F.lower(name).rlike(rf"\.({extensions})$"), fv.FILE_TYPE_NOT_ALLOWED
    )
    kind = F.when(file_type(name) == "pdf", "PDF").otherwise("Imagen")
    return F.struct(
        error.isNull().alias("valid"),
        F.when(error.isNull(), kind).alias("type"),
        F.when(error.isNull(), size_label(size)).alias("size"),
        error.alias("error"),
    )
