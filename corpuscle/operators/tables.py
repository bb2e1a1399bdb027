"""Row-level changes on immutable tables, ownership, validation, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.config import DEFAULTS, Settings, materialize
from corpuscle.functions import vocab as V
from corpuscle.functions.identity import first_non_blank, normalized_role
from corpuscle.functions.text import is_blank, strip


# --- changes ---------------------------------------------------------------------------------


def upsert(target: DataFrame, updates: DataFrame, key: str, keep_null: bool = True, settings: Settings = DEFAULTS) -> DataFrame:
    """Target with updates applied by key. With `keep_null` a null update leaves the value.

    Few updates are broadcast behind a count: the target is read where it lies, once for the rows it has and once for the keys that
    it lacks. More of them meet the target by key in a full join.
    """
    updates = materialize(updates, "updates")
    small = settings.broadcast_max_bytes // _UPDATE_BYTES
    t, marked = target.alias("t"), updates.withColumn("_touched", F.lit(True)).alias("u")
    if updates.limit(small + 1).count() > small:
        joined = t.join(marked, F.col(f"t.{key}") == F.col(f"u.{key}"), "full")
        return joined.select(*[_merged(c, key, updates.columns, keep_null) for c in target.columns])
    changed = t.join(F.broadcast(marked), F.col(f"t.{key}") == F.col(f"u.{key}"), "left").select(*[_merged(c, key, updates.columns, keep_null) for c in target.columns])
    # Keys that are there already: as few as the updates, whatever the target.
    known = target.select(key).join(F.broadcast(updates.select(key)), key, "left_semi").distinct()
    missing = updates.join(F.broadcast(known), key, "left_anti")
    absent = [F.col(c) if c in updates.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns]
    return changed.unionByName(missing.select(*absent))


_UPDATE_BYTES = 512


def _merged(name: str, key: str, given: list[str], keep_null: bool) -> Column:
    if name == key:
        return F.coalesce(f"t.{key}", f"u.{key}").alias(key)
    if name not in given:
        return F.col(f"t.{name}").alias(name)
    if keep_null:
        return F.coalesce(f"u.{name}", f"t.{name}").alias(name)
    return F.when(F.col("u._touched"), F.col(f"u.{name}")).otherwise(F.col(f"t.{name}")).alias(name)


# --- tables stored by buckets of their key ----------------------------------------------------


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(table: DataFrame, path: str, key: str, buckets: int) -> None:
    """Store a table by buckets of its key. Choose so many that a bucket is some hundred MB."""
    placed = table.withColumn("_bucket", _bucket(key, buckets))
    placed.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def upsert_buckets(spark: SparkSession, path: str, schema: T.StructType, updates: DataFrame, key: str, buckets: int, keep_null: bool = True) -> int:
    """Apply updates to a stored table: only the buckets that hold an updated key are read, merged and replaced; returns how many.

    The merged buckets are written aside first, so a job that fails before the replacement leaves the table as it was.
    """
    updates = materialize(updates.withColumn("_bucket", _bucket(key, buckets)), "updates")
    touched = sorted(r[0] for r in updates.select("_bucket").distinct().collect())  # one number a bucket at most
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(path)
    merged = upsert(stored.filter(F.col("_bucket").isin(touched)).drop("_bucket"), updates.drop("_bucket"), key, keep_null)
    merged = materialize(merged.withColumn("_bucket", _bucket(key, buckets)), "merged-buckets")
    merged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    return len(touched)


def delete_rows(target: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(table without the rows, one-row count of the deleted ones)."""
    wanted = ids.select(key)
    gone = target.join(wanted, key, "left_semi").agg(F.count(F.lit(1)).alias("documents_deleted"))
    return target.join(wanted, key, "left_anti"), gone


def rollback_file(target: DataFrame, file_ids: DataFrame, file: str = "original_file_id") -> DataFrame:
    """Table without any row of files whose ingest failed."""
    return target.join(file_ids.select(file), file, "left_anti")


def delete_cascade(
    users: DataFrame, analyses: DataFrame, images: DataFrame, jobs: DataFrame, user_ids: DataFrame
) -> dict[str, DataFrame]:
    """Remove users with everything they own, and jobs of removed images."""
    gone = user_ids.select("user_id")
    left_images = images.join(gone, "user_id", "left_anti")
    left_analyses = analyses.join(gone, "user_id", "left_anti")
    left_jobs = jobs.join(gone, "user_id", "left_anti")
    for side in ("lateral_id", "superior_id"):
        left_jobs = left_jobs.join(left_images.select(F.col("id").alias(side)), side, "left_semi")
    return {
        "users": users.join(gone, "user_id", "left_anti"),
        "analyses": left_analyses,
        "images": detach_analyses(left_images, left_analyses),
        "jobs": left_jobs,
    }


def detach_analyses(images: DataFrame, analyses: DataFrame) -> DataFrame:
    """Set the analysis of an image to null when that analysis no longer exists."""
    known = analyses.select(F.col("id").alias("analysis_id"), F.lit(True).alias("_known")).distinct()
    return (
        images.join(known, "analysis_id", "left")
        .withColumn("analysis_id", F.when(F.col("_known"), F.col("analysis_id")))
        .select(*images.columns)
    )


# --- ownership -------------------------------------------------------------------------------


def owned_by(df: DataFrame, user, column: str = "user_id") -> DataFrame:
    return df.filter(F.col(column) == user)


def owned_objects(df: DataFrame, user: str, path: str = "storage_path") -> DataFrame:
    """Objects whose first path segment is the user."""
    return df.filter(F.split_part(F.col(path), F.lit("/"), F.lit(1)) == user)


def with_role(users: DataFrame, role: str = "role") -> DataFrame:
    return users.withColumn("role", normalized_role(role)).withColumn("is_admin", F.col("role") == "admin")


def accounts(users: DataFrame, profiles: DataFrame, key: str = "user_id") -> DataFrame:
    """Users with their profile, where there is one."""
    marked = profiles.withColumn("has_profile", F.lit(True))
    return users.join(marked, key, "left").withColumn(
        "has_profile", F.coalesce("has_profile", F.lit(False))
    )


# --- listings --------------------------------------------------------------------------------


def between(c: str, low=None, high=None) -> Column:
    """Inclusive range; a null value fails as soon as a bound is given."""
    cond = F.lit(True)
    if low is not None:
        cond = cond & (F.col(c) >= low)
    if high is not None:
        cond = cond & (F.col(c) <= high)
    return cond


def list_images(images: DataFrame, user, tag: str | None = None, date_from=None, date_to=None) -> DataFrame:
    rows = owned_by(images, user).filter(between("uploaded_at", date_from, date_to))
    if tag:
        rows = rows.filter(F.col("tag") == tag)
    return rows.orderBy(F.desc("uploaded_at"), "id")


def list_measurements(rows: DataFrame, user, date_from=None, date_to=None, kvol_min=None, kvol_max=None) -> DataFrame:
    kept = owned_by(rows, user).filter(between("created_at", date_from, date_to) & between("kvol", kvol_min, kvol_max))
    return kept.orderBy(F.desc("created_at"), "id")


def list_library(videos: DataFrame) -> DataFrame:
    """Library rows with trimmed titles, default category, newest first."""
    return videos.select(
        "id",
        strip("title").alias("title"),
        F.nullif(strip("description"), F.lit("")).alias("description"),
        F.coalesce(first_non_blank("category"), F.lit(V.DEFAULT_CATEGORY)).alias("category"),
        "filename",
        "file_size",
        "created_at",
        "uploaded_by",
    ).orderBy(F.desc("created_at"), "id")


# --- profile validation ----------------------------------------------------------------------


def validate_profiles(profiles: DataFrame) -> DataFrame:
    """Normalised profiles with `ok` and the list of `errors`."""
    out = profiles
    required = ("full_name", "phone")
    for name in V.PROFILE_MAX_LENGTHS:
        if name in out.columns and name not in required:
            out = out.withColumn(name, F.when(~is_blank(name), F.col(name)))
    if "address_state" in out.columns:
        out = out.withColumn("address_state", F.upper(strip("address_state")))

    checks: list[tuple[str, Column]] = []
    for name in required:
        if name in out.columns:
            checks.append((f"{name}: required", F.coalesce(F.length(name), F.lit(0)) == 0))
    for name, limit in V.PROFILE_MAX_LENGTHS.items():
        if name in out.columns:
            checks.append((f"{name}: longer than {limit}", F.length(name) > limit))
    if "farming_type" in out.columns:
        checks.append(("farming_type: unknown", ~F.coalesce(F.col("farming_type").isin(*V.FARMING_TYPES), F.lit(False))))
    if "annual_production_tons" in out.columns:
        tons = F.col("annual_production_tons")
        checks.append(("annual_production_tons: required", tons.isNull()))
        checks.append(("annual_production_tons: negative", tons < 0))
        checks.append(("annual_production_tons: more than one decimal", tons != F.round(tons, 1)))
    for name in ("water_surface_area_ha", "tank_count"):
        if name in out.columns:
            checks.append((f"{name}: negative", F.col(name) < 0))
    if "address_state" in out.columns:
        checks.append(("address_state: unknown", ~F.col("address_state").isin(*V.STATES)))
    errors = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for text, cond in checks]))
    return out.withColumn("errors", errors).withColumn("ok", F.size("errors") == 0)
