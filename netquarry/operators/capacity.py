"""Bounded tables as in a single process: least-recently-used eviction and admission under pressure.

At scale the state store spills and watermarks drop what is old, so nothing needs these caps. They reproduce what a
capacity-bounded table would do with packets in order, which is sequential by nature: a shard's packets are one group.
"""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lru(packets: DataFrame, capacity: int, shard: str, key: str = "src_ip") -> DataFrame:
    """For each shard: entries left (by ``key``: sources, or clients of DNS), evictions, and the packets that the surviving entries counted since they were (re)made."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        table: OrderedDict[str, int] = OrderedDict()
        evicted = 0
        for ip in rows.sort_values(["us", "event_id"])[key]:
            if ip not in table and len(table) >= capacity:
                table.popitem(last=False)
                evicted += 1
            table[ip] = table.pop(ip, 0) + 1
        return pd.DataFrame({"shard": [rows[shard].iloc[0]], "tracked": [len(table)], "evicted": [evicted], "counted": [sum(table.values())]})

    return packets.select(shard, "us", "event_id", key).groupBy(shard).applyInPandas(run, "shard long, tracked long, evicted long, counted long")


def admission(flows: DataFrame, capacity: int, idle_us: int, shard: str, scan: int = 100) -> DataFrame:
    """New flows in order at a full table: the oldest of the first ``scan`` entries idle for longer gives way, else the
    new flow is dropped and counted as degraded. Input: shard, us, event_id, flow."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        table: OrderedDict[str, int] = OrderedDict()
        evicted = degraded = 0
        for now, flow in rows.sort_values(["us", "event_id"])[["us", "flow"]].itertuples(index=False):
            if flow in table:
                table.move_to_end(flow)
            elif len(table) >= capacity:
                idle = next((k for (k, seen), _ in zip(table.items(), range(scan)) if now - seen > idle_us), None)
                if idle is None:
                    degraded += 1
                    continue
                del table[idle]
                evicted += 1
            table[flow] = now
        return pd.DataFrame({"shard": [rows[shard].iloc[0]], "tracked": [len(table)], "evicted": [evicted], "degraded": [degraded]})

    return flows.select(F.col(shard), "us", "event_id", "flow").groupBy(shard).applyInPandas(run, "shard long, tracked long, evicted long, degraded long")
