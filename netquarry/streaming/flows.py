"""The flow lane over a stream: the same transitions as the batch fold, in keyed state with event-time timers.

Needs the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.flows import KEY, Limits, canonical

STATE = "confirmed boolean, first long, last long, n int, seg int, packets long, bytes long, syn long, fwd_packets long, fwd_bytes long, pre long"
OUT = "a_ip string, a_port int, b_ip string, b_port int, protocol string, seg int, packet_count long, byte_count long, syn_count long, fwd_packet_count long, fwd_byte_count long, pre_promotion_packet_count long, first_us long, last_us long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(state: list | None, us: int, size: int, syn: bool, forward: bool, limits: Limits) -> tuple[list, list | None]:
    """The state after a packet, and the confirmed segment that it ended, if any."""
    ended = None
    confirmed, first, last, n, seg = state[:5] if state else (False, us, us, 0, 0)
    stays = confirmed and us - last <= limits.inactive_us and us - first <= limits.active_us
    grows = not confirmed and n > 0 and us - first <= limits.ttl_us
    if not (stays or grows):
        ended = state if confirmed else None
        state = [False, us, us, 0, seg + 1, 0, 0, 0, 0, 0, 0]
    state = list(state)
    state[3] += 1
    state[2] = max(state[2], us)
    if not state[0] and state[3] >= limits.threshold:
        state[0], state[10] = True, state[3] - 1
    if state[0]:
        state[5] += 1
        state[6] += size
        state[7] += int(syn)
        state[8] += int(forward)
        state[9] += size if forward else 0
    return state, ended


class FlowProcessor(StatefulProcessor):
    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("flow", STATE)

    def _row(self, key, s: list) -> pd.DataFrame:
        return pd.DataFrame([(*key, s[4], s[5], s[6], s[7], s[8], s[9], s[10], s[1], s[2])], columns=[c.split()[0] for c in OUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.state.get()) if self.state.exists() else None
        packets = pd.concat(list(rows)).sort_values(["us", "event_id"])
        for us, size, syn, forward in packets[["us", "packet_size", "syn", "is_forward"]].itertuples(index=False):
            state, ended = advance(state, int(us), int(size), bool(syn), bool(forward), self.limits)
            if ended:
                yield self._row(key, ended)
        self.state.update(tuple(state))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        ends = min(state[2] + self.limits.inactive_us, state[1] + self.limits.active_us) if state[0] else state[1] + self.limits.ttl_us
        self.handle.registerTimer(ends // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Closes a flow that stayed silent; provisional ones vanish."""
        if self.state.exists():
            state = list(self.state.get())
            if state[0]:
                yield self._row(key, state)
            self.state.clear()

    def close(self) -> None:
        pass


def flow_stream(packets: DataFrame, limits: Limits, lateness: str = "1 second") -> DataFrame:
    """Closed confirmed segments of a stream of packets (ts, event_id, and the packets' columns), as they end."""
    keyed = canonical(packets.withWatermark("ts", lateness)).withColumn("us", F.unix_micros("ts"))
    columns = [*KEY, "ts", "us", "event_id", "packet_size", "syn", "is_forward"]
    return keyed.select(*columns).groupBy(*KEY).transformWithStateInPandas(FlowProcessor(limits), OUT, "append", "EventTime")
