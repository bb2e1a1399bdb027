"""Admission of uploaded files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import vocab as V
from corpuscle.functions.text import with_nfkc
from corpuscle.functions.identity import sanitize_filename, sniff_type


def admit_uploads(files: DataFrame, kind: str, name: str = "original_file_name") -> DataFrame:
    """Verdict per file: extension, size and real type. The first failing test is the reason."""
    extensions, types, megabytes = V.UPLOAD_KINDS[kind]
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    detected = sniff_type("content")
    reason = (
        F.when(F.coalesce(F.col(name), F.lit("")) == "", "missing name")
        .when(~ext.isin(*extensions), "extension not allowed")
        .when(F.length("content") > megabytes * 1024 * 1024, "too large")
        .when(~F.coalesce(detected.isin(*types), F.lit(False)), "content does not match")
    )
    judged = files.select(
        *[c for c in files.columns if c != "content"],
        detected.alias("detected_type"),
        F.col(name).alias("safe_name"),
        reason.alias("reason"),
        reason.isNull().alias("admitted"),
    )
    return with_nfkc(judged, "safe_name").withColumn("safe_name", sanitize_filename("safe_name"))
