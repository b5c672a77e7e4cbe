"""Workspace reports: history, projects, seats, audit, each within one tenant.

A session claims a tenant in a variable, and guarded views show that tenant's rows alone:
none at all without a claim.  The filter is part of the view, so it reaches the scan and
partitions of other tenants are not read.  Spark cannot keep a session that may run any
SQL from reading the tables under the views; that is for the catalogue's permissions.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tenant(table: DataFrame, firm: str | int) -> DataFrame:
    """The rows of one firm."""
    return table.where(F.col("firm_id") == firm)


CLAIM = "tenant_claim"


def claim(spark: SparkSession, firm: str | int | None) -> None:
    """Say whose rows this session may see from here on; None withdraws the claim."""
    spark.sql(f"DECLARE OR REPLACE VARIABLE {CLAIM} STRING DEFAULT NULL")
    if firm is not None:
        spark.sql(f"SET VAR {CLAIM} = :firm", args={"firm": str(firm)})


def guard(table: DataFrame, name: str) -> DataFrame:
    """A view ``name`` of a table with firm_id that shows the claimed tenant's rows; read anew at each use.

    Without a claim, or with a null firm_id, no row is seen.  A claim made later holds for
    every query on the view that is built after it.
    """
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"{name!r} is no name of a view")
    spark = table.sparkSession
    if not _declared(spark):
        claim(spark, None)
    table.createOrReplaceTempView(f"{name}__all")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT * FROM {name}__all WHERE CAST(firm_id AS STRING) = session.{CLAIM}")
    return spark.table(name)


def _declared(spark: SparkSession) -> bool:
    try:
        spark.sql(f"SELECT session.{CLAIM}")
    except AnalysisException:
        return False
    return True


def _page(df: DataFrame, limit: int, offset: int, most: int) -> DataFrame:
    """A page of at most ``most`` rows: the report's own feature."""
    return df.offset(max(0, int(offset))).limit(min(max(1, int(limit)), most))


def recent_checks(checks: DataFrame, projects: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, id as tie-break, with the project's name if there is one."""
    named = checks.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id", "left")
    return _page(named.orderBy(F.desc("created_at"), F.desc("id")), limit, offset, 200)


def project_summary(projects: DataFrame, checks: DataFrame) -> DataFrame:
    """Projects with their number of checks and the last one; empty projects count 0."""
    per = checks.groupBy("project_id").agg(F.count("*").alias("check_count"), F.max("created_at").alias("last_check_at"))
    return projects.join(per.withColumnRenamed("project_id", "id"), "id", "left").withColumn("check_count", F.coalesce("check_count", F.lit(0).cast("long")))


def seat_usage(firms: DataFrame, checks: DataFrame, as_of: str) -> DataFrame:
    """Seats in use (people with a check) and checks in the month of ``as_of``, per firm."""
    month = F.date_trunc("month", F.lit(as_of).cast("timestamp"))
    used = checks.groupBy("firm_id").agg(F.count_distinct("user_id").alias("seats_used"), F.count_if(F.col("created_at") >= month).alias("checks_this_month"))
    joined = firms.join(used, "firm_id", "left")
    return joined.select(*firms.columns, F.coalesce("seats_used", F.lit(0).cast("long")).alias("seats_used"), F.coalesce("checks_this_month", F.lit(0).cast("long")).alias("checks_this_month"))


def audit_trail(log: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """What was done, newest first."""
    return _page(log.orderBy(F.desc("occurred_at"), F.desc("id")), limit, offset, 500)
