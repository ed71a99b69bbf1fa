"""Closed-form capacity formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def db_qps(total_qps: Column, hit_ratio: Column) -> Column:
    return total_qps * (F.lit(1.0) - hit_ratio)


def memory_bytes(items: Column, item_bytes: Column, overhead: Column, replicas: Column, headroom: Column) -> Column:
    return items * item_bytes * (F.lit(1.0) + overhead) * replicas * (F.lit(1.0) + headroom)


def avg_latency(hit_ratio: Column, cache_ms: Column, db_ms: Column) -> Column:
    return hit_ratio * cache_ms + (F.lit(1.0) - hit_ratio) * db_ms


def node_count(total: Column, per_node: Column) -> Column:
    return F.ceil(total / per_node).cast("bigint")
