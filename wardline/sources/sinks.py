"""Where reports, evidence and plans are written. Large outputs stay in many files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import lookup_join
from wardline.operators.audit import grant_snapshot
from wardline.operators.evidence import evidence_manifest, evidence_rows
from wardline.operators.review import exception_report
from wardline.sources.publish import publish


def _below(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def write_exception_report(exceptions: DataFrame, path: str, run_id: str) -> str:
    """CSV with a header, most severe first."""
    target = _below(path, f"exception_report_{run_id}")
    exception_report(exceptions).write.mode("overwrite").csv(target, header=True)
    return target


def write_evidence(exceptions: DataFrame, path: str, run_id: str, matrix_sha: str) -> DataFrame:
    """JSON snapshot of a run and its digest; returns the manifest row."""
    manifest = evidence_manifest(exceptions, run_id, matrix_sha)
    rows = evidence_rows(exceptions, run_id).select("body")
    rows.write.mode("overwrite").text(_below(path, f"audit_evidence/run_id={run_id}"))
    target = _below(path, f"audit_manifest/run_id={run_id}")
    manifest.write.mode("overwrite").json(target)
    return manifest.sparkSession.read.schema(manifest.schema).json(target)


def write_plan(plan: DataFrame, path: str, run_id: str) -> None:
    """Rollback statements first, complete on disk before any revoke is handed out."""
    plan.select("rollback_sql").write.mode("overwrite").text(_below(path, f"rollback_{run_id}"))
    plan.select("revoke_sql").write.mode("overwrite").text(_below(path, f"revoke_{run_id}"))


def owned(exceptions: DataFrame, owners: DataFrame) -> DataFrame:
    """The exceptions with their ``owner`` from (identity, owner), or UNOWNED."""
    met = lookup_join(exceptions, owners.select("identity", "owner"), ["identity"], "left")
    return met.withColumn("owner", F.coalesce("owner", F.lit("UNOWNED")))


def write_owner_reports(exceptions: DataFrame, owners: DataFrame, path: str) -> None:
    """One folder per owner, directly below ``path``, with only their exceptions.

    An owner gets as many tasks and files as the bytes need.
    """
    reports = owned(exceptions, owners).hint("rebalance", F.col("owner"))
    reports.write.mode("overwrite").partitionBy("owner").parquet(path)


def publish_owner_reports(exceptions: DataFrame, owners: DataFrame, path: str) -> DataFrame:
    """The same reports, all of a run replaced in one step; returns what is stored."""
    return publish(owned(exceptions, owners), path, ["owner"])


def write_grant_snapshot(grants_to_roles: DataFrame, grants_to_users: DataFrame, path: str) -> None:
    """The live grants as a baseline table."""
    grant_snapshot(grants_to_roles, grants_to_users).write.mode("errorifexists").parquet(path)
