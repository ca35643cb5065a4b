"""Motor commands: throttled authorisation, request ladder, lifecycle, acceptance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions import fixed
from sentrel.functions.scalars import bucket_of, evaluated_once, hmac_sha256, is_hex64
from sentrel.functions.staging import materialise
from sentrel.operators.telemetry import fresh, is_number, json_type, strict_json
from sentrel.operators.windows import prefix_max


def _chain_ends(times: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start in sorted ``times``: the last pick of the greedy chain from there, and how
    many picks it has."""
    n = len(times)
    jump = np.append(np.searchsorted(times, times + gap, "left"), n)
    last, picks = np.arange(n + 1), np.append(np.ones(n, np.int64), 0)
    while (jump[:n] < n).any():
        last = np.where(jump < n, last[jump], last)
        picks = picks + picks[jump]
        jump = jump[jump]
    return last[:n], picks[:n]


def _steps(entries: np.ndarray, exits: np.ndarray, picks: np.ndarray) -> dict:
    """A step function without the entries that share the outcome of the next one."""
    keep = np.append((exits[1:] != exits[:-1]) | (picks[1:] != picks[:-1]), True)
    return {"entries": [entries[keep].tolist()], "exits": [exits[keep].tolist()], "picks": [picks[keep].tolist()]}


def _follow(functions: pd.DataFrame, ready: np.ndarray, gap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """State (instant from which on a sample counts, picks so far) before each of the step functions,
    and after the last, for several instants ``ready`` at once."""
    ready, count = ready.copy(), np.zeros(len(ready), np.int64)
    for entries, exits, picks in zip(functions["entries"], functions["exits"], functions["picks"], strict=True):
        yield ready.copy(), count.copy()
        at = np.searchsorted(entries, ready, "left")
        hit = np.flatnonzero(at < len(entries))
        ready[hit] = np.asarray(exits)[at[hit]] + gap
        count[hit] += np.asarray(picks)[at[hit]]
    yield ready, count


STEPS = "entries array<bigint>, exits array<bigint>, picks array<bigint>"
#: Before any sample.
START = np.iinfo(np.int64).min


def authorise(
    samples: DataFrame,
    gap_seconds: float = fixed.COMMAND_GAP_SECONDS,
    lifetime_seconds: float = fixed.COMMAND_LIFETIME_SECONDS,
    bucket_seconds: int = 60,
    span: int = 1024,
) -> DataFrame:
    """Accepted samples (``controller, us, decision_id``) to commands.

    A sample makes a command when the controller's last command is at least ``gap`` old. That
    greedy choice is a chain, but a bucket of time maps "ready from" to "last pick, picks" on its
    own, and such step functions compose: buckets are solved in parallel, ``span`` buckets are
    composed into one function without knowing what came before, only those are followed along a
    controller (about one row in 17 hours), and spans and then buckets list what they pick, already
    numbered. A composed function has at most one step more than the first of its parts.
    """
    gap = int(gap_seconds * 1_000_000)
    width = int(bucket_seconds * 1_000_000)
    if width < gap:
        raise ValueError("a bucket must be at least one gap long")
    # One sample per instant: the earliest decision of an instant is the one that counts.
    instants = materialise(
        samples.groupBy("controller", "us")
        .agg(F.min("decision_id").alias("decision_id"))
        .withColumn("bucket", bucket_of("us", width))
    )

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(rows["us"].to_numpy())
        last, picks = _chain_ends(t, gap)
        # Only a first pick within one gap of the bucket's start, or the first one after it,
        # can be asked for.
        head = int(np.searchsorted(t, key[1] * width + gap, "left")) + 1
        return pd.DataFrame(
            {"controller": [key[0]], "bucket": [key[1]], **_steps(t[:head], t[last[:head]], picks[:head])}
        )

    steps = instants.select("controller", "bucket", "us").groupBy("controller", "bucket").applyInPandas(
        solve, f"controller string, bucket bigint, {STEPS}"
    )
    # Composed, and then followed from what came before: written once.
    steps = materialise(steps.withColumn("span", bucket_of("bucket", span)))

    def compose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        # Who is ready after the first bucket's samples is so before the second one's.
        second = rows["entries"].iloc[1][:1] if len(rows) > 1 else []
        entries = np.concatenate([rows["entries"].iloc[0], second]).astype(np.int64)
        *_, (ready, count) = _follow(rows, entries, gap)
        return pd.DataFrame({"controller": [key[0]], "span": [key[1]], **_steps(entries, ready - gap, count)})

    def enter(order: str, columns: list[str]):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(order)
            ready, before = (
                (rows["ready"].iloc[0], rows["before"].iloc[0]) if "ready" in rows.columns else (START, 0)
            )
            states = list(_follow(rows, np.array([ready], np.int64), gap))[:-1]
            return rows[columns].assign(ready=[int(r[0]) for r, _ in states], before=[int(n[0] + before) for _, n in states])

        return run

    spans = steps.groupBy("controller", "span").applyInPandas(compose, f"controller string, span bigint, {STEPS}")
    entered = spans.groupBy("controller").applyInPandas(
        enter("span", ["controller", "span"]), "controller string, span bigint, ready bigint, before bigint"
    )
    ready = (
        steps.join(entered, ["controller", "span"])
        .groupBy("controller", "span")
        .applyInPandas(
            enter("bucket", ["controller", "bucket"]), "controller string, bucket bigint, ready bigint, before bigint"
        )
    )

    def pick(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("us")
        t = rows["us"].to_numpy()
        chosen, due = [], int(rows["ready"].iloc[0])
        while (i := int(np.searchsorted(t, due, "left"))) < len(t):
            chosen.append(i)
            due = int(t[i]) + gap
        sequence = int(rows["before"].iloc[0]) + 1 + np.arange(len(chosen))
        return rows.iloc[chosen][["controller", "us", "decision_id"]].assign(sequence=sequence)

    issued = (
        instants.join(ready, ["controller", "bucket"])
        .groupBy("controller", "bucket")
        .applyInPandas(pick, "controller string, us bigint, decision_id bigint, sequence bigint")
    )
    commands = issued.select(
        "controller",
        F.md5(F.concat_ws("|", "controller", F.col("us").cast("string"))).alias("command_id"),
        "sequence",
        F.col("decision_id").alias("sensor_decision_id"),
        F.col("us").alias("issued_us"),
        (F.col("us") + int(lifetime_seconds * 1_000_000)).alias("expires_us"),
    )
    return materialise(commands)


def with_decisions(commands: DataFrame, decisions: DataFrame) -> DataFrame:
    """Commands with the sensor decision that triggered each."""
    return commands.join(
        decisions, commands["sensor_decision_id"] == decisions["message_id"]
    ).drop("message_id")


def latest_command(commands: DataFrame) -> DataFrame:
    """The newest command of every controller."""
    cols = [c for c in commands.columns if c != "controller"]
    return (
        commands.groupBy("controller")
        .agg(F.max_by(F.struct(*cols), "sequence").alias("c"))
        .select("controller", "c.*")
    )


def open_command_at(
    polls: DataFrame,
    commands: DataFrame,
    lifetime_seconds: float = fixed.COMMAND_LIFETIME_SECONDS,
) -> DataFrame:
    """Each poll (``controller, poll_id, us``) with the earliest unexpired command, if any.

    Interval join on buckets of one lifetime; a command lies in two of them at most.
    """
    width = int(lifetime_seconds * 1_000_000)
    spans = commands.select(
        "controller", "command_id", "sequence", "issued_us", "expires_us"
    ).withColumn(
        "b", F.explode(F.array_distinct(F.array(bucket_of("issued_us", width), bucket_of("expires_us", width))))
    )
    hits = (
        polls.withColumn("b", bucket_of("us", width))
        .join(spans, ["controller", "b"])
        .where(F.col("us").between(F.col("issued_us"), F.col("expires_us")))
        .groupBy("poll_id")
        .agg(F.min_by("command_id", "sequence").alias("command_id"))
    )
    return polls.join(hits, "poll_id", "left")


def command_status(
    commands: DataFrame, as_of_us: int, request_log: DataFrame | None = None
) -> DataFrame:
    """Status and outcome of every command at an instant.

    ``request_log`` is the output of :func:`decide_requests`; without it no command counts as
    delivered.
    """
    known = commands.where(F.col("issued_us") <= as_of_us)
    if request_log is None:
        known = known.withColumns(
            {"__out": F.lit(None).cast("string"), "__sent": F.lit(None).cast("boolean")}
        )
    else:
        ok = request_log.where(F.col("us") <= as_of_us)
        acks = (
            ok.where(F.col("reason") == "MOTOR_ACK_ACCEPTED")
            .groupBy("command_id")
            .agg(F.max_by("outcome", F.struct("us", "request_id")).alias("__out"))
        )
        sent = (
            ok.where(F.col("delivered").isNotNull())
            .select(F.col("delivered").alias("command_id"), F.lit(True).alias("__sent"))
            .distinct()
        )
        known = known.join(acks, "command_id", "left").join(sent, "command_id", "left")
    expired = F.col("expires_us") < as_of_us
    status = (
        F.when(F.col("__out").isNotNull(), "ACKNOWLEDGED")
        .when(expired, "EXPIRED")
        .when(F.col("__sent"), "DELIVERED")
        .otherwise("PENDING")
    )
    outcome = F.coalesce("__out", F.when(expired, "UNKNOWN"))
    return known.select(
        *commands.columns, status.alias("status"), outcome.alias("outcome")
    )


def check_requests(requests: DataFrame, controllers: DataFrame, key: bytes) -> DataFrame:
    """Stateless part of the request ladder; ``reason`` is null for requests that pass.

    ``requests``: ``request_id, received_at, kind (motor_poll | motor_ack), raw, signature``;
    ``controllers``: ``controller``. Runs on streams too.
    """
    doc = F.col("__doc")
    parsed = requests.withColumn("__doc", strict_json("raw"))

    def value(path, kind):
        return F.try_variant_get(doc, path, kind)

    def kind_of(path):
        return json_type(doc, path)

    parsed = parsed.withColumns(
        {
            "__device": F.when(kind_of("$.device_id") == "STRING", value("$.device_id", "string")),
            "sequence": value("$.sequence", "bigint"),
            "command_id": value("$.command_id", "string"),
            "outcome": value("$.outcome", "string"),
        }
    )
    right_kind = (
        (kind_of("$.message_type") == "STRING")
        & (value("$.message_type", "string") == F.col("kind"))
        & kind_of("$.device_id").isNotNull()
    )
    ack = (
        (kind_of("$.command_id") == "STRING")
        & (F.length("command_id") == 32)
        & (kind_of("$.outcome") == "STRING")
        & F.col("outcome").isin(*fixed.ACK_OUTCOMES)
    )
    typed = (
        (kind_of("$.sequence") == "BIGINT")
        & (F.col("sequence") >= 1)
        & is_number(kind_of("$.timestamp"))
        & ((F.col("kind") != "motor_ack") | ack)
    )

    def fails(c: Column) -> Column:
        return ~F.coalesce(c, F.lit(False))

    signed = is_hex64("signature") & (
        F.lower("signature") == hmac_sha256("raw", key)
    )
    early = (
        F.when(F.lit(not key), "MOTOR_NOT_CONFIGURED")
        .when(fails(signed), "INVALID_HMAC")
        .when(fails(right_kind), "INVALID_SCHEMA")
    )
    late = F.when(fails(typed), "INVALID_SCHEMA").when(
        fails(fresh("received_at", value("$.timestamp", "double"))), "INVALID_TIMESTAMP"
    )
    is_ack = F.col("kind") == "motor_ack"
    rated = evaluated_once(
        parsed,
        ["request_id", "received_at"],
        {
            "us": F.unix_micros("received_at"),
            "request_sha256": F.sha2("raw", 256),
            "kind": F.col("kind"),
            "sequence": F.col("sequence"),
            "command_id": F.when(is_ack, F.col("command_id")),
            "outcome": F.when(is_ack, F.col("outcome")),
            "__device": F.col("__device"),
            "early": early,
            "late": late,
        },
    )
    known = controllers.select("controller").distinct()
    known = known.withColumn("__k", F.concat(F.lit("="), "controller"))
    own = F.concat(F.lit("#"), F.col("request_id").cast("string"))
    keyed = rated.withColumn(
        "__k",
        F.when(
            F.col("early").isNull() & F.col("__device").isNotNull(),
            F.concat(F.lit("="), "__device"),
        ).otherwise(own),
    )
    unknown = F.when(F.col("controller").isNull(), "WRONG_DEVICE")
    joined = keyed.join(known, "__k", "left")
    return joined.select(
        "request_id", "received_at", "us", "request_sha256", "kind", "controller", "sequence",
        "command_id", "outcome", F.coalesce("early", unknown, "late").alias("reason"),
    )


def _order(us: str, rank: Column | str) -> Column:
    """Place in a controller's log; issues and samples (-1) come before requests of an instant."""
    return F.struct(F.col(us).alias("us"), (F.col(rank) if isinstance(rank, str) else rank).cast("bigint").alias("rid"))


def _next_sweep(commands: DataFrame, sweeps: DataFrame, bucket_us: int) -> DataFrame:
    """First sweep (``controller, us, rid``) later than each command's expiry, as ``swept``.

    A prefix maximum over reversed time, so it is chained in buckets like the others.
    """
    marks = commands.select(
        "controller", (-F.col("expires_us")).alias("nt"), F.lit(0).alias("k"), "command_id",
        F.lit(None).cast("struct<us:bigint,rid:bigint>").alias("v"), F.lit(0).cast("bigint").alias("nr"),
    )
    times = sweeps.select(
        "controller", (-F.col("us")).alias("nt"), F.lit(1).alias("k"),
        F.lit(None).cast("string").alias("command_id"),
        F.struct((-F.col("us")).alias("us"), (-F.col("rid")).alias("rid")).alias("v"),
        (-F.col("rid")).alias("nr"),
    )
    found = prefix_max(
        marks.unionByName(times), ["controller"], "nt", ["nt", "k", "nr"], "v", "m", bucket_us
    ).where(F.col("k") == 0)
    back = F.struct((-F.col("m.us")).alias("us"), (-F.col("m.rid")).alias("rid"))
    return found.select("command_id", F.when(F.col("m").isNotNull(), back).alias("swept"))


def _poll_candidates(polls: DataFrame, commands: DataFrame, bucket_us: int) -> DataFrame:
    """Polls with the commands whose lifetime covers them; bucketed interval join."""
    first, last = bucket_of("issued_us", bucket_us), bucket_of("expires_us", bucket_us)
    spans = commands.select(
        "controller", "command_id", F.col("sequence").alias("rank"), "issued_us", "expires_us",
        F.explode(F.sequence(first, last)).alias("b"),
    )
    return (
        polls.select("controller", "us", "request_id", bucket_of("us", bucket_us).alias("b"))
        .join(spans, ["controller", "b"])
        .where(F.col("us").between(F.col("issued_us"), F.col("expires_us")))
        .select("request_id", "us", "command_id", "rank")
    )


def decide_requests(
    requests: DataFrame,
    commands: DataFrame,
    controllers: DataFrame,
    key: bytes,
    samples: DataFrame | None = None,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Verdict of every controller request in arrival order.

    A refused ACK does not advance the sequence, so one running maximum does not settle it.
    But the verdict of a request follows from which earlier ones were accepted, and given
    those, sequences are prefix maxima and command states are aggregates per command. So the
    accepted set is refined until it stays the same: after each round all verdicts before the
    first unsettled request are final. A few rounds do in practice, and no controller's log is
    ever handled by one task.
    """
    bucket = int(bucket_seconds * 1_000_000)
    checked = materialise(check_requests(requests, controllers, key))
    asked = checked.where(F.col("reason").isNull()).select(
        "controller", "us", "request_id", "kind", "sequence", "command_id", "outcome"
    )
    is_poll = F.col("kind") == "motor_poll"
    covered = materialise(_poll_candidates(asked.where(is_poll), commands, bucket))
    ticks = commands.select("controller", F.col("issued_us").alias("us"))
    if samples is not None:
        ticks = ticks.union(samples.select("controller", "us"))
    ticks = ticks.select("controller", "us", F.lit(-1).cast("bigint").alias("rid"))
    place = _order("us", "request_id")

    def rate(rows: DataFrame) -> DataFrame:
        """Sequence check for rows with ``fit``: would be accepted but for their sequence."""
        seen = F.when(F.col("fit"), F.col("sequence"))
        ranked = prefix_max(
            rows, ["controller"], "us", ["us", "request_id"], seen, "last", bucket
        )
        new = F.col("sequence") > F.coalesce("last", F.lit(0))
        return ranked.withColumn("new", new).withColumn("ok", F.col("fit") & new)

    def accepted(rows: DataFrame):
        mark = F.sum(F.xxhash64("request_id").cast("decimal(38,0)"))
        return rows.where("ok").agg(F.count("*"), mark).first()

    current = materialise(
        rate(asked.withColumns({"fit": F.lit(True), "conflict": F.lit(False)}))
        .withColumn("delivered", F.lit(None).cast("string"))
    )
    settled = accepted(current)
    while True:
        ok = current.where("ok")
        acks = (
            ok.where(~is_poll)
            .groupBy("command_id")
            .agg(F.min(F.struct(place.alias("at"), "outcome")).alias("a"))
            .select("command_id", F.col("a.at").alias("acked"), F.col("a.outcome").alias("first_outcome"))
        )
        # A poll delivers the first open command: covered by time and not acknowledged before.
        sent = (
            covered.join(ok.where(is_poll).select("request_id"), "request_id", "left_semi")
            .join(acks.select("command_id", "acked"), "command_id", "left")
            .where(F.col("acked").isNull() | (F.col("acked") > place))
            .groupBy("request_id")
            .agg(F.min_by(F.struct("command_id", place.alias("at")), "rank").alias("d"))
            .select("request_id", "d.command_id", "d.at")
        )
        first_sent = sent.groupBy("command_id").agg(F.min("at").alias("sent"))
        sweeps = ticks.union(
            ok.where(is_poll).select("controller", "us", F.col("request_id").alias("rid"))
        )
        states = (
            commands.select("controller", "command_id", _order("issued_us", F.lit(-1)).alias("issued"))
            .join(_next_sweep(commands, sweeps, bucket), "command_id")
            .join(first_sent, "command_id", "left")
            .join(acks, "command_id", "left")
        )
        before = {
            c: F.coalesce(F.col(c) < place, F.lit(False)) for c in ("issued", "sent", "swept", "acked")
        }
        known = before["issued"] & (before["sent"] | before["swept"] | before["acked"])
        conflict = before["acked"] & (F.col("first_outcome") != F.col("outcome"))
        # Only ACKs name a command; polls always fit.
        rated = (
            asked.where(~is_poll)
            .join(states, ["controller", "command_id"], "left")
            .withColumn("conflict", F.coalesce(conflict, F.lit(False)))
            .withColumn("fit", known & ~F.col("conflict"))
            .select(*asked.columns, "fit", "conflict")
            .union(asked.where(is_poll).select("*", F.lit(True), F.lit(False)))
        )
        deliveries = sent.select("request_id", F.col("command_id").alias("delivered"))
        current = materialise(
            rate(rated).join(deliveries, "request_id", "left").select(*current.columns)
        )
        now = accepted(current)
        if now == settled:  # the next round would start from the same set
            break
        settled = now
    verdict = (
        F.when(~F.col("new"), "REPLAY_OR_SEQUENCE_RESET")
        .when(is_poll, "MOTOR_POLL_ACCEPTED")
        .when(F.col("conflict"), "CONFLICTING_ACK")
        .when(F.col("fit"), "MOTOR_ACK_ACCEPTED")
        .otherwise("COMMAND_NOT_DELIVERED")
    )
    verdicts = current.select(
        "request_id", verdict.alias("verdict"), F.when(F.col("ok"), F.col("delivered")).alias("delivered")
    )
    return (
        checked.join(verdicts, "request_id", "left")
        .withColumn("reason", F.coalesce("reason", "verdict"))
        .drop("verdict")
    )


def accept_commands(
    envelopes: DataFrame, device: str, key: bytes, bucket_seconds: int = 3600
) -> DataFrame:
    """Controller-side acceptance of delivered commands.

    ``envelopes``: ``envelope_id, received_at, payload BINARY, signature``. A command that
    passes the checks counts once, in strictly increasing sequence.
    """
    doc = F.col("__doc")
    parsed = envelopes.withColumn("__doc", strict_json("payload"))

    def value(path, kind):
        return F.try_variant_get(doc, path, kind)

    seconds = F.unix_micros("received_at") / 1e6
    duration = value("$.duration_seconds", "double")
    checks = {
        "BAD_SIGNATURE": is_hex64("signature")
        & (F.lower("signature") == hmac_sha256("payload", key)),
        "WRONG_DEVICE": value("$.device_id", "string") == device,
        "WRONG_TYPE": value("$.message_type", "string") == "motor_command",
        "WRONG_VERSION": value("$.schema_version", "bigint") == 1,
        "WRONG_ACTION": value("$.action", "string") == "ON",
        "OUTSIDE_INTERVAL": seconds.between(
            value("$.issued_at", "double"), value("$.expires_at", "double")
        ),
        "BAD_DURATION": is_number(json_type(doc, "$.duration_seconds"))
        & (duration > 0)
        & (duration <= fixed.MAX_COMMAND_SECONDS),
        "BAD_SEQUENCE": json_type(doc, "$.sequence") == "BIGINT",
    }
    reason = F.lit(None).cast("string")
    for name, ok in reversed(checks.items()):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    staged = materialise(parsed.select(
        "envelope_id",
        "received_at",
        F.unix_micros("received_at").alias("us"),
        F.lit(device).alias("device"),
        value("$.command_id", "string").alias("command_id"),
        value("$.sequence", "bigint").alias("sequence"),
        reason.alias("reason"),
    ))
    passed = prefix_max(
        staged.where(F.col("reason").isNull()),
        ["device"],
        "us",
        ["us", "envelope_id"],
        "sequence",
        "__last",
        bucket_seconds * 1_000_000,
    ).withColumn(
        "reason",
        F.when(F.col("sequence") <= F.coalesce("__last", F.lit(0)), "OLD_COMMAND").otherwise("EXECUTED"),
    )
    both = passed.select(*staged.columns).unionByName(staged.where(F.col("reason").isNotNull()))
    return both.drop("device")
