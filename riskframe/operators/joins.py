"""Keyed look-ups and upserts as joins.

Join strategy: the user dimension grows with the data, so it is never
broadcast by hint; AQE turns the sort-merge join into a broadcast at run time
when the measured size is below ``spark.sql.autoBroadcastJoinThreshold`` and
splits skewed partitions of the fact side (a hot user) otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.prefix import running_sums
from riskframe.schema import GUEST_NAME

#: FIXED VALUE: longest stored user name.
NAME_CHARS = 40
#: Key of the one user whose name is missing (no trimmed name is this character).
NO_NAME = "\u0000"


def name_key(name: Column) -> Column:
    """Names are matched without regard to case and outer blanks; missing names are one user."""
    return F.coalesce(F.lower(F.trim(name)), F.lit(NO_NAME))


def latest_per_key(df: DataFrame, key: str, ts: str, value_cols: list[str]) -> DataFrame:
    """Last write wins per key.

    The order is (ts, values), so equal timestamps give the same row whatever the input
    order (the largest values win).  ``max`` over one struct is a partial aggregate: each map
    task keeps one row per key, so a hot key never lands whole in one task.
    """
    last = df.groupBy(key).agg(F.max(F.struct(ts, *value_cols)).alias("_last"))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in [*value_cols, ts]])


def attach_user(apps: DataFrame, users: DataFrame, guest_name: str = GUEST_NAME) -> DataFrame:
    """Evaluation gets the user's id and name; unknown user -> guest (id NULL)."""
    u = users.select(F.col("user_id").alias("_uid"), F.col("name").alias("_uname"))
    j = apps.join(u, apps["user_id"] == u["_uid"], "left")
    return j.withColumn("user_name", F.coalesce(F.col("_uname"), F.lit(guest_name))) \
        .withColumn("user_id", F.col("_uid")).drop("_uid", "_uname")


def apply_labels(evals: DataFrame, labels: DataFrame, prefer_real: bool = True) -> DataFrame:
    """Latest label per evaluation, ``coalesce(real, predicted, 0)``."""
    last = latest_per_key(labels, "app_id", "labelled_at", ["aprobado_real"]).drop("labelled_at")
    j = evals.join(last, "app_id", "left")
    if prefer_real:
        y = F.coalesce(F.col("aprobado_real"), F.col("aprobado"), F.lit(0))
    else:
        y = F.coalesce(F.col("aprobado"), F.lit(0))
    return j.withColumn("aprobado", y.cast("int"))


def duplicate_emails(users: DataFrame) -> DataFrame:
    """E-mails held by more than one user (data-quality form of the unique index)."""
    e = users.filter(F.col("email").isNotNull()).withColumn("email", F.lower(F.trim("email")))
    return e.groupBy("email").agg(F.count(F.lit(1)).alias("n_users"), F.min("user_id").alias("first_user_id")) \
        .filter(F.col("n_users") > 1)


def upsert_users(existing: DataFrame, arrivals: DataFrame, now_col: str = "ts") -> DataFrame:
    """Insert-if-new else touch, matching names case-insensitively.

    ``arrivals`` = (name, ts) visit events.  They are first reduced to one row
    per normalised name (partial aggregation), then full-outer joined with the
    dimension: matched users get ``visits + n`` and the newest ``last_seen``;
    unmatched names become new users with ``visits = n``, cut to ``NAME_CHARS``
    characters, and ids that follow the largest one in the order of the names.  A missing name
    is a name of its own: all such visits are one user's.
    """
    key = name_key(F.col("name"))
    new = arrivals.withColumn("_k", key).groupBy("_k").agg(
        F.min(F.struct(now_col, "name"))["name"].alias("_new_name"),
        F.count(F.lit(1)).alias("_n"), F.min(now_col).alias("_first"), F.max(now_col).alias("_last"))
    old = existing.withColumn("_k", key)
    fresh = running_sums(new.join(old.select("_k"), "_k", "left_anti").withColumn("_one", F.lit(1)), "_k", ["_one"])
    top = existing.agg(F.coalesce(F.max("user_id"), F.lit(0)).alias("m")).scalar()
    zero = F.lit(0).cast("bigint")
    inserted = fresh.select(
        (top + F.col("cum__one")).cast("bigint").alias("user_id"), F.substring(F.trim("_new_name"), 1, NAME_CHARS).alias("name"),
        F.col("_first").alias("created_at"), F.col("_last").alias("last_seen"), F.col("_n").alias("visits"),
        zero.alias("evaluations"), F.lit(True).alias("is_new"))
    touched = old.join(new, "_k", "left").select(
        "user_id", "name", "created_at", F.greatest("last_seen", "_last").alias("last_seen"),
        (F.coalesce("visits", zero) + F.coalesce("_n", zero)).cast("bigint").alias("visits"),
        F.coalesce("evaluations", zero).cast("bigint").alias("evaluations"), F.lit(False).alias("is_new"))
    return touched.unionByName(inserted)


def new_users(existing: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Arrivals with no existing user of the same (case-insensitive) name (``left_anti``)."""
    k_old = existing.select(name_key(F.col("name")).alias("_k"))
    a = arrivals.withColumn("_k", name_key(F.col("name")))
    return a.join(k_old, "_k", "left_anti").drop("_k")
