"""Telemetry and command queries."""

from pyspark.sql import functions as F

from sentrel.operators import commands as cmd
from sentrel.operators import telemetry as tel
from sentrel.plans import adapters as ad
from sentrel.plans.registry import query

TELEMETRY = """m AS (SELECT event_id AS message_id, epoch_us(ts) AS us, user_id % 10 AS dev,
    event_id - CASE WHEN event_id % 11 = 0 THEN 500 ELSE 0 END AS sequence,
    epoch_us(ts) // 1000000 - CASE WHEN event_id % 13 = 0 THEN 45 WHEN event_id % 17 = 0 THEN -20
      ELSE 5 END AS measured_at,
    CAST(value AS DECIMAL(10, 2)) - 20 AS temperature, (event_id * 37) % 4200 AS turbidity_raw
  FROM events),
b AS (SELECT *, '{"device_id":"sensor-' || dev || '","timestamp":' || measured_at || ',"sequence":'
    || sequence || ',"sensors":{"temperature_c":' || temperature || ',"turbidity_raw":'
    || turbidity_raw || '}}' || CASE WHEN message_id % 19 = 0 THEN ' ' ELSE '' END AS body,
    CASE WHEN message_id % 19 = 0 THEN 'INVALID_HMAC'
      WHEN sequence < 1 THEN 'INVALID_JSON_OR_SCHEMA'
      WHEN dev = 9 THEN 'UNREGISTERED_DEVICE'
      WHEN turbidity_raw > 4095 OR temperature < -55 OR temperature > 125
        THEN 'SENSOR_VALUES_OUT_OF_RANGE'
      WHEN us / 1e6 - measured_at < -10 OR us / 1e6 - measured_at > 30 THEN 'INVALID_TIMESTAMP'
      END AS early FROM m),
r AS (SELECT *, max(sequence) OVER (PARTITION BY dev ORDER BY us, message_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b WHERE early IS NULL),
d AS (SELECT *, CASE WHEN sequence <= seen THEN 'REPLAY_OR_SEQUENCE_RESET'
      ELSE 'VERIFIED_INTEGRITY_ONLY' END AS reason FROM r
  UNION ALL SELECT *, NULL, early FROM b WHERE early IS NOT NULL),
dec AS (SELECT message_id, us, sha256(body) AS payload_sha256,
    CASE WHEN k THEN 'sensor-' || dev END AS device_id, CASE WHEN k THEN sequence END AS sequence,
    CASE WHEN k THEN measured_at END AS measured_at,
    CASE WHEN k THEN CAST(temperature AS DOUBLE) END AS temperature_c,
    CASE WHEN k THEN turbidity_raw END AS turbidity_raw,
    CASE WHEN reason = 'VERIFIED_INTEGRITY_ONLY' THEN 'ACCEPTED' ELSE 'REJECTED' END AS decision,
    reason
  FROM (SELECT *, reason IN ('INVALID_TIMESTAMP', 'REPLAY_OR_SEQUENCE_RESET',
    'VERIFIED_INTEGRITY_ONLY') AS k FROM d))"""

COMMANDS = f"""{TELEMETRY},
smp AS (SELECT 'motor-' || (CAST(split_part(device_id, '-', 2) AS INT) % 2) AS controller, us,
    min(message_id) AS decision_id FROM dec WHERE decision = 'ACCEPTED' GROUP BY 1, 2),
nx AS (SELECT a.controller, a.us, a.decision_id, min(b.us) AS nus FROM smp a
  LEFT JOIN smp b ON a.controller = b.controller AND b.us >= a.us + 900000000
    AND b.us < a.us + 90000000000 GROUP BY ALL),
ch AS (SELECT controller, min(us) AS us FROM smp GROUP BY controller
  UNION ALL SELECT nx.controller, nx.nus FROM ch JOIN nx ON ch.controller = nx.controller
    AND ch.us = nx.us WHERE nx.nus IS NOT NULL),
cm AS (SELECT ch.controller, md5(ch.controller || '|' || ch.us) AS command_id,
    row_number() OVER (PARTITION BY ch.controller ORDER BY ch.us) AS sequence,
    decision_id AS sensor_decision_id, ch.us AS issued_us, ch.us + 600000000 AS expires_us
  FROM ch JOIN nx ON ch.controller = nx.controller AND ch.us = nx.us)"""


def _decisions(spark, sf_dir):
    devices = spark.createDataFrame([(d,) for d in ad.REGISTERED_DEVICES], "device_id string")
    return tel.decide(ad.telemetry(spark, sf_dir), devices, ad.TEST_KEY)


def _samples(spark, sf_dir):
    return ad.samples_of(_decisions(spark, sf_dir))


def _commands(spark, sf_dir):
    return cmd.authorise(
        _samples(spark, sf_dir), ad.COMMAND_GAP_SECONDS, ad.COMMAND_LIFETIME_SECONDS, 86_400
    )


@query("telemetry_decisions", f"WITH {TELEMETRY} SELECT * FROM dec")
def telemetry_decisions(spark, sf_dir):
    found = _decisions(spark, sf_dir).withColumn("us", F.unix_micros("received_at"))
    return found.drop("received_at")


@query(
    "decision_counts",
    f"WITH {TELEMETRY} SELECT decision, reason, count(*) AS n FROM dec GROUP BY ALL",
)
def decision_counts(spark, sf_dir):
    return tel.decision_counts(_decisions(spark, sf_dir))


@query(
    "replay_state",
    f"""WITH {TELEMETRY} SELECT device_id, max(sequence) AS last_sequence FROM dec
    WHERE decision = 'ACCEPTED' GROUP BY device_id""",
)
def replay_state(spark, sf_dir):
    return tel.replay_state(_decisions(spark, sf_dir))


@query(
    "oversized_messages",
    f"""WITH {TELEMETRY} SELECT message_id, us, 'PAYLOAD_TOO_LARGE' AS reason FROM b
    WHERE strlen(body) > 113""",
)
def oversized_messages(spark, sf_dir):
    """With a limit of 113 bytes, so that some messages are over it."""
    found = tel.oversized(ad.telemetry(spark, sf_dir), 113)
    return found.select("message_id", F.unix_micros("received_at").alias("us"), "reason")


@query("command_throttle", f"WITH RECURSIVE {COMMANDS} SELECT * FROM cm")
def command_throttle(spark, sf_dir):
    return _commands(spark, sf_dir)


@query(
    "command_latest",
    f"""WITH RECURSIVE {COMMANDS} SELECT * FROM cm
    QUALIFY row_number() OVER (PARTITION BY controller ORDER BY sequence DESC) = 1""",
)
def command_latest(spark, sf_dir):
    return cmd.latest_command(_commands(spark, sf_dir))


@query(
    "command_decision",
    f"""WITH RECURSIVE {COMMANDS} SELECT command_id, device_id, dec.sequence AS sample_sequence
    FROM cm JOIN dec ON cm.sensor_decision_id = dec.message_id""",
)
def command_decision(spark, sf_dir):
    decisions = _decisions(spark, sf_dir)
    commands = _commands(spark, sf_dir).drop("sequence")
    return cmd.with_decisions(commands, decisions).select(
        "command_id", "device_id", F.col("sequence").alias("sample_sequence")
    )


@query(
    "command_open_at_poll",
    f"""WITH RECURSIVE {COMMANDS},
    pl AS (SELECT event_id AS poll_id, 'motor-' || (event_id % 2) AS controller,
      epoch_us(ts) AS us FROM events)
    SELECT pl.*, c.command_id FROM pl LEFT JOIN (
      SELECT poll_id, arg_min(command_id, sequence) AS command_id FROM pl JOIN cm
        ON pl.controller = cm.controller AND us BETWEEN issued_us AND expires_us
      GROUP BY poll_id) c USING (poll_id)""",
)
def command_open_at_poll(spark, sf_dir):
    polls = ad.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("poll_id"),
        F.concat(F.lit("motor-"), (F.col("event_id") % 2).cast("string")).alias("controller"),
        F.unix_micros("ts").alias("us"),
    )
    return cmd.open_command_at(polls, _commands(spark, sf_dir), ad.COMMAND_LIFETIME_SECONDS)


REQUESTS = f"""{COMMANDS},
st(k, s) AS (VALUES (0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 700)),
rq AS (SELECT sensor_decision_id * 10 + k AS request_id, controller, command_id,
    issued_us + s * 1000000 AS us, k, sensor_decision_id % 4 AS g FROM cm, st),
rv AS (SELECT *, CASE
    WHEN g = 1 AND k = 1 THEN 'INVALID_HMAC'
    WHEN g = 2 AND k IN (1, 2) THEN 'WRONG_DEVICE'
    WHEN g = 3 AND k = 1 THEN 'INVALID_TIMESTAMP'
    WHEN k = 0 THEN 'COMMAND_NOT_DELIVERED'
    WHEN k = 1 THEN 'MOTOR_POLL_ACCEPTED'
    WHEN k = 2 AND g = 0 THEN 'REPLAY_OR_SEQUENCE_RESET'
    WHEN k = 2 THEN 'MOTOR_POLL_ACCEPTED'
    WHEN k = 3 AND g = 2 THEN 'COMMAND_NOT_DELIVERED'
    WHEN k = 3 THEN 'MOTOR_ACK_ACCEPTED'
    WHEN k = 4 AND g = 2 THEN 'COMMAND_NOT_DELIVERED'
    WHEN k = 4 THEN 'CONFLICTING_ACK'
    WHEN k = 5 THEN 'MOTOR_POLL_ACCEPTED'
    ELSE 'MOTOR_ACK_ACCEPTED' END AS reason,
    CASE WHEN (g = 0 AND k = 1) OR (g IN (1, 3) AND k = 2) OR (g = 2 AND k = 5)
      THEN command_id END AS delivered FROM rq)"""


def _requests(spark, sf_dir):
    commands = _commands(spark, sf_dir)
    controllers = spark.createDataFrame([(c,) for c in ad.CONTROLLERS], "controller string")
    log = cmd.decide_requests(
        ad.controller_requests(commands), commands, controllers, ad.TEST_KEY
    )
    return commands, log


@query(
    "controller_requests",
    f"WITH RECURSIVE {REQUESTS} SELECT request_id, us, reason, delivered FROM rv",
)
def controller_requests(spark, sf_dir):
    return _requests(spark, sf_dir)[1].select("request_id", "us", "reason", "delivered")


@query(
    "command_status",
    f"""WITH RECURSIVE {REQUESTS}, t AS (SELECT CAST(1705276800000000 AS BIGINT) AS now_us),
    dl AS (SELECT delivered AS command_id, min(us) AS sent FROM rv WHERE delivered IS NOT NULL
      GROUP BY 1),
    ak AS (SELECT command_id, min(us) AS done FROM rv WHERE reason = 'MOTOR_ACK_ACCEPTED'
      GROUP BY 1)
    SELECT cm.*, CASE WHEN done <= now_us THEN 'ACKNOWLEDGED' WHEN expires_us < now_us THEN 'EXPIRED'
        WHEN sent <= now_us THEN 'DELIVERED' ELSE 'PENDING' END AS status,
      CASE WHEN done <= now_us THEN 'COMPLETED_OFF' WHEN expires_us < now_us THEN 'UNKNOWN' END AS outcome
    FROM cm CROSS JOIN t LEFT JOIN dl USING (command_id) LEFT JOIN ak USING (command_id)
    WHERE issued_us <= now_us""",
)
def command_status(spark, sf_dir):
    commands, log = _requests(spark, sf_dir)
    return cmd.command_status(commands, 1_705_276_800_000_000, log)


@query(
    "command_acceptance",
    f"""WITH RECURSIVE {COMMANDS},
    ev AS (SELECT *, sensor_decision_id AS n FROM cm, range(2) c(copy)
      WHERE controller = 'motor-0')
    SELECT n * 10 + copy AS envelope_id, command_id, sequence,
      CASE WHEN n % 13 = 1 THEN 'BAD_SIGNATURE' WHEN n % 11 = 1 THEN 'WRONG_VERSION'
        WHEN n % 5 = 1 THEN 'WRONG_ACTION' WHEN n % 7 = 1 THEN 'BAD_DURATION'
        WHEN copy = 1 THEN 'OLD_COMMAND' ELSE 'EXECUTED' END AS reason FROM ev""",
)
def command_acceptance(spark, sf_dir):
    sent = ad.envelopes(_commands(spark, sf_dir), "motor-0")
    found = cmd.accept_commands(sent, "motor-0", ad.TEST_KEY, 86_400)
    return found.select("envelope_id", "command_id", "sequence", "reason")
