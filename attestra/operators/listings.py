"""What a user sees of their own: queries, workspaces, answers kept in them; the newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERIES, WORKSPACES, ANSWERS = 20, 25, 20


def newest(rows: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows of each key, with their rank; order must be total."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= limit)


def queries_of_users(history: DataFrame, limit: int = QUERIES) -> DataFrame:
    """history: query_id, user_id, workspace_id, created_at."""
    return newest(history.where("user_id is not null"), ["user_id"], [F.desc("created_at"), F.desc("query_id")], limit)


def queries_of_workspaces(history: DataFrame, limit: int = QUERIES) -> DataFrame:
    """By user and workspace; queries outside a workspace are in none."""
    return newest(history.where("user_id is not null and workspace_id is not null"), ["user_id", "workspace_id"], [F.desc("created_at"), F.desc("query_id")], limit)


def workspaces_of_users(cases: DataFrame, limit: int = WORKSPACES) -> DataFrame:
    """cases: case_id, owner_id, appellant, respondent, court, case_number, stage, case_type, n_documents, updated_at, created_at, as items of a list."""
    items = newest(cases.where("owner_id is not null"), ["owner_id"], [F.desc("updated_at"), F.desc("created_at"), F.desc("case_id")], limit)
    return items.select("owner_id", "rank", "case_id", "appellant", "respondent", "court", "case_number", "stage", "case_type", "n_documents", "updated_at")


def saved_answers(answers: DataFrame, limit: int = ANSWERS) -> DataFrame:
    """answers: answer_id, user_id, workspace_id, overall_status, created_at."""
    return newest(answers, ["user_id", "workspace_id"], [F.desc("created_at"), F.desc("answer_id")], limit)


def latest_public_run(runs: DataFrame) -> DataFrame:
    """The last completed run that is public (runs: run_id, status, is_public, completed_at); a maximum, so no table is sorted."""
    done = runs.where("status = 'completed' and is_public")
    columns = [c for c in runs.columns if c not in ("completed_at", "run_id")]
    best = done.agg(F.max(F.struct("completed_at", "run_id", *columns)).alias("r")).where("r is not null")
    return best.select("r.*")


def run_created(runs: DataFrame, new: DataFrame) -> DataFrame:
    """runs with new ones (suite, started_at, metrics) added: queued, private, under an id that follows from suite and start."""
    key = F.substr(F.sha1(F.concat_ws("|", "suite", F.col("started_at").cast("string"))), F.lit(1), F.lit(32))
    rows = new.select(key.alias("run_id"), "suite", F.lit("queued").alias("status"), F.lit(False).alias("is_public"), "started_at", F.lit(None).cast("timestamp").alias("completed_at"), "metrics")
    return runs.unionByName(rows.join(runs.select("run_id"), "run_id", "left_anti"), allowMissingColumns=True)
