"""The stamped evidence package of a monthly review: each section and its header."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from wardline.operators import audit, rolegraph


def sections(tables: Mapping[str, DataFrame], as_of) -> dict[str, DataFrame]:
    """The sections an attestation covers, by name."""
    g2r, g2u = tables["grants_to_roles"], tables["grants_to_users"]
    users, policies = tables["users"], tables["policy_references"]
    return {
        "user_roster": audit.user_roster(users),
        "phi_entitlements": rolegraph.phi_entitlement_extract(g2r, g2u, users),
        "policy_evidence": audit.policy_evidence(policies),
        "failed_logins": audit.failed_logins(tables["login_history"], as_of),
        "tagged_unmasked": audit.tagged_unmasked_columns(tables["tag_references"], policies),
    }


def write_package(
    tables: Mapping[str, DataFrame], path: str, period: str, account: str, region: str,
    reviewer: str, as_of,
) -> DataFrame:
    """Write all sections of ``period`` and return the header over the stored copies."""
    root = f"{path.rstrip('/')}/period={period}"
    stored = {}
    for name, section in sections(tables, as_of).items():
        section.write.mode("overwrite").parquet(f"{root}/{name}")
        stored[name] = section.sparkSession.read.schema(section.schema).parquet(f"{root}/{name}")
    header = audit.attestation_header(stored, account, region, reviewer, as_of)
    header.write.mode("overwrite").parquet(f"{root}/attestation_header")
    return header
