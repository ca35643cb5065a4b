"""Structured Streaming versions of flows, telemetry decisions, commands and controller logs.

Stateful operators use the RocksDB state store; :func:`use_rocksdb` sets it on a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sentrel.functions import fixed
from sentrel.operators import flows, telemetry

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_flows(
    packets: DataFrame,
    window_seconds: int = fixed.FLOW_WINDOW_SECONDS,
    lateness: str = "5 seconds",
    **params,
) -> DataFrame:
    """Flow features in event-time windows; a window is final once the watermark passes it."""
    return flows.flow_features(packets.withWatermark("ts", lateness), window_seconds, **params)


class LastSequence(StatefulProcessor):
    """Accept a sequence if it exceeds the device's last accepted one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "message_id"])
        last = self._last.get()[0] if self._last.exists() else 0
        before = batch["sequence"].cummax().shift(fill_value=last).clip(lower=last)
        new = batch["sequence"] > before
        batch["reason"] = new.map(
            {True: "VERIFIED_INTEGRITY_ONLY", False: "REPLAY_OR_SEQUENCE_RESET"}
        )
        self._last.update((int(max(last, batch["sequence"].max())),))
        yield batch

    def close(self) -> None:
        pass


def stream_decisions(messages: DataFrame, devices: DataFrame, key: bytes) -> DataFrame:
    """Decisions on a message stream; only messages that pass every other check keep state."""
    checked = telemetry.check_messages(messages, devices, key).withColumn(
        "us", F.unix_micros("received_at")
    )
    names = checked.columns
    judged = (
        checked.where(F.col("reason").isNull())
        .groupBy("device_id")
        .transformWithStateInPandas(
            LastSequence(), checked.schema, outputMode="Append", timeMode="None"
        )
    )
    failed = checked.where(F.col("reason").isNotNull())
    both = judged.select(*names).unionByName(failed.select(*names))
    return telemetry.shape_decisions(both.drop("us"))


class Throttle(StatefulProcessor):
    """Issue a command when the last one is at least one gap old."""

    def __init__(self, gap_us: int, lifetime_us: int):
        self._gap, self._life = gap_us, lifetime_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "issued bigint, sequence bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "decision_id"])
        issued, sequence = self._last.get() if self._last.exists() else (None, 0)
        out = []
        for us, decision in zip(batch["us"], batch["decision_id"]):
            if issued is None or us - issued >= self._gap:
                issued, sequence = int(us), sequence + 1
                out.append((key[0], sequence, int(decision), issued, issued + self._life))
        if issued is not None:
            self._last.update((issued, sequence))
        cols = ["controller", "sequence", "sensor_decision_id", "issued_us", "expires_us"]
        yield pd.DataFrame(out, columns=cols)

    def close(self) -> None:
        pass


def stream_commands(
    samples: DataFrame,
    gap_seconds: float = fixed.COMMAND_GAP_SECONDS,
    lifetime_seconds: float = fixed.COMMAND_LIFETIME_SECONDS,
) -> DataFrame:
    """Commands from a stream of accepted samples (``controller, us, decision_id``)."""
    schema = (
        "controller string, sequence bigint, sensor_decision_id bigint, issued_us bigint, "
        "expires_us bigint"
    )
    issued = samples.groupBy("controller").transformWithStateInPandas(
        Throttle(int(gap_seconds * 1e6), int(lifetime_seconds * 1e6)),
        schema,
        outputMode="Append",
        timeMode="None",
    )
    digest = F.md5(F.concat_ws("|", "controller", F.col("issued_us").cast("string")))
    return issued.withColumn("command_id", digest)


class ControllerState:
    """Sequence and command states of one controller; a fold over its ordered log."""

    def __init__(self, last: int = 0, commands: dict | None = None):
        self.last = last
        # command id -> [status, outcome, expiry, sequence]
        self.commands = commands if commands is not None else {}
        self.open = [c for c, s in self.commands.items() if s[0] in ("PENDING", "DELIVERED")]

    def _expire(self, now: int) -> None:
        still = []
        for c in self.open:
            state = self.commands[c]
            if state[0] not in ("PENDING", "DELIVERED"):
                continue
            if state[2] < now:
                state[0], state[1] = "EXPIRED", "UNKNOWN"
            else:
                still.append(c)
        self.open = still

    def sample(self, now: int) -> None:
        self._expire(now)

    def issue(self, now: int, command: str, expires: int, sequence: int) -> None:
        self._expire(now)
        self.commands[command] = ["PENDING", None, expires, sequence]
        self.open.append(command)

    def poll(self, now: int, sequence: int) -> tuple[str, str | None]:
        if sequence <= self.last:
            return "REPLAY_OR_SEQUENCE_RESET", None
        self._expire(now)
        found = min(self.open, key=lambda c: self.commands[c][3], default=None)
        if found is not None:
            self.commands[found][0] = "DELIVERED"
        self.last = sequence
        return "MOTOR_POLL_ACCEPTED", found

    def ack(self, sequence: int, command: str, outcome: str) -> str:
        if sequence <= self.last:
            return "REPLAY_OR_SEQUENCE_RESET"
        state = self.commands.get(command)
        if state is None or state[0] == "PENDING":
            return "COMMAND_NOT_DELIVERED"
        if state[0] == "ACKNOWLEDGED" and state[1] != outcome:
            return "CONFLICTING_ACK"
        state[0], state[1] = "ACKNOWLEDGED", outcome
        self.last = sequence
        return "MOTOR_ACK_ACCEPTED"


FOLD_COLUMNS = [
    "controller", "us", "rank", "request_id", "kind", "sequence", "command_id", "outcome",
    "expires_us",
]


def fold_rows(state: ControllerState, rows: pd.DataFrame) -> list[tuple]:
    """Run ordered log rows through the state; verdicts of the requests among them."""
    out = []
    for r in rows.itertuples(index=False):
        if r.kind == "issue":
            state.issue(r.us, r.command_id, int(r.expires_us), int(r.sequence))
        elif r.kind == "sample":
            state.sample(r.us)
        elif r.kind == "motor_poll":
            reason, sent = state.poll(r.us, int(r.sequence))
            out.append((int(r.request_id), reason, sent))
        else:
            reason = state.ack(int(r.sequence), r.command_id, r.outcome)
            out.append((int(r.request_id), reason, None))
    return out


class ControllerLog(StatefulProcessor):
    """The controller fold with its state in the store; loads only commands a batch touches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._head = handle.getValueState("head", "last bigint, open string")
        self._commands = handle.getMapState(
            "commands", "id string", "status string, outcome string, expires bigint, seq bigint"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "rank", "request_id"])
        last, opened = self._head.get() if self._head.exists() else (0, "")
        wanted = set(filter(None, opened.split(","))) | set(batch["command_id"].dropna())
        known = {
            c: list(self._commands.getValue((c,)))
            for c in wanted
            if self._commands.containsKey((c,))
        }
        state = ControllerState(last, known)
        out = fold_rows(state, batch)
        for c, value in state.commands.items():
            self._commands.updateValue((c,), tuple(value))
        still = [c for c in state.open if state.commands[c][0] in ("PENDING", "DELIVERED")]
        self._head.update((int(state.last), ",".join(still)))
        yield pd.DataFrame(out, columns=["request_id", "reason", "delivered"])

    def close(self) -> None:
        pass


def stream_requests(log: DataFrame) -> DataFrame:
    """Verdicts for a stream of log rows in ``FOLD_COLUMNS``."""
    return log.select(*FOLD_COLUMNS).groupBy("controller").transformWithStateInPandas(
        ControllerLog(),
        "request_id bigint, reason string, delivered string",
        outputMode="Append",
        timeMode="None",
    )


def distinct_messages(messages: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Drop transport repeats of one message while its id is within the watermark."""
    return messages.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(
        ["message_id"]
    )


def append_to(df: DataFrame, path: str, checkpoint: str, form: str = "parquet"):
    """Append a stream to a folder; process what is there, then stop."""
    return (
        df.writeStream.format(form)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
