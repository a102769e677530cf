"""Registry of runnable queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyfence.frames import duck_frames

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is what an independent engine must answer identically."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def with_frames(body: str, ctes: str = "", recursive: bool = False) -> str:
    head = "with recursive" if recursive else "with"
    tail = f",\n{ctes}" if ctes else ""
    return f"{head} frames as ({duck_frames()}){tail}\n{body}"


def fold_ctes(cand: str, keys: str, cool_us: int, name: str = "kept", source: str = "cand") -> str:
    """Recursive form of the cooldown fold: next kept row is the first one at least C later."""
    ks = [k.strip() for k in keys.split(",")]
    on = " and ".join(f"c.{k} = f.{k}" for k in ks)
    cols = ", ".join(f"c.{k}" for k in ks)
    same = " and ".join(f"c.{k} = f.{k}" for k in ks)
    return f"""{source} as materialized ({cand}),
{name}_t as (
  select {keys}, min(t_us) as t from {source} group by {keys}
  union all
  select {cols}, min(c.t_us) as t from {name}_t f join {source} c on {on} and c.t_us >= f.t + {cool_us}
  group by {cols}, f.t),
{name} as (
  select c.* from {source} c join {name}_t f on {same} and c.t_us = f.t
  qualify row_number() over (partition by {cols}, c.t_us order by c.event_id) = 1)"""
