"""Which nodes report, with which agent versions, and where they run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_nodes(fact: DataFrame, node: str = "node_id", ts_min: str = "ts_min", days: int = 30) -> DataFrame:
    """Distinct nodes seen in the last ``days`` before the fact's newest minute."""
    newest = fact.agg(F.max(ts_min)).scalar()
    return fact.filter(F.col(ts_min) > newest - 1440 * days).select(F.col(node).alias("node_id")).distinct()


def compat_version(a: str = "") -> Column:
    return F.concat_ws(".", *[
        F.col(a + c) for c in ("major_release", "minor_release", "point_release", "agent_point_release")
    ])


def agent_versions(active: DataFrame, mapping: DataFrame, agents: DataFrame) -> DataFrame:
    """Active node-agent pairs counted by version.

    ``mapping`` has (node_id, agent_id), ``agents`` (id, the four release parts,
    agent_version). ``active`` ids are distinct, so the inner join is a semi join.
    """
    return (
        mapping.join(active, "node_id", "left_semi")
        .join(agents.withColumnRenamed("id", "agent_id"), "agent_id")
        .groupBy(compat_version().alias("compat"), F.left("agent_version", F.lit(60)).alias("version"))
        .agg(F.count("*").alias("agents"))
    )


def locate_agents(
    active: DataFrame, mapping: DataFrame, agents: DataFrame, nodes: DataFrame,
    tiers: DataFrame, apps: DataFrame, machines: DataFrame, version: tuple[int, int, int, int],
) -> DataFrame:
    """Where active agents of one exact version run: application, tier, node and machine."""
    major, minor, point, agent_point = version
    wanted = agents.filter(
        (F.col("major_release") == major) & (F.col("minor_release") == minor)
        & (F.col("point_release") == point) & (F.col("agent_point_release") == agent_point)
    ).select(F.col("id").alias("agent_id"))
    return (
        mapping.join(wanted, "agent_id", "left_semi")
        .join(active, "node_id", "left_semi")
        .join(nodes.select(
            F.col("id").alias("node_id"), F.col("name").alias("node_name"),
            "machine_instance_id", "application_component_id"), "node_id")
        .join(tiers.select(
            F.col("id").alias("application_component_id"), F.col("name").alias("tier_name"),
            "application_id"), "application_component_id")
        .join(apps.select(F.col("id").alias("application_id"), F.col("name").alias("app_name")), "application_id")
        .join(machines.select(
            F.col("id").alias("machine_instance_id"), F.col("name").alias("machine_name"),
            "ip_address", "internal_name"), "machine_instance_id")
        .select("app_name", "tier_name", "node_name", "machine_name", "ip_address", "internal_name")
    )


def compact_unpartitioned(tables: DataFrame, partitions: DataFrame) -> DataFrame:
    """Unpartitioned tables still in Compact row format, largest first."""
    whole = partitions.filter(F.col("partition_name").isNull()).select("table_schema", "table_name")
    return (
        tables.filter(F.col("row_format") == "Compact")
        .join(whole, ["table_schema", "table_name"])
        .select(F.concat_ws(".", "table_schema", "table_name").alias("full_name"), "table_rows")
        .orderBy(F.desc("table_rows"))
    )
