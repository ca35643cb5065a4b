"""Which device an address belonged to at an instant.

Claims are intervals of any length, also without an end. They are never joined by interval: a claim
adds one, its device's number and the number's square to running sums at its start and takes them off
at its end. At any instant the sums tell how many claims hold, and whether they are all of one device:
n claims of numbers d agree exactly if n * sum(d * d) = sum(d) ** 2. Claims and observations are read
along an address in time buckets, so an address with a third of all rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.staging import materialise
from sentrel.operators.windows import running

DAY_US = 86_400_000_000
RESOLVED, AMBIGUOUS, UNRESOLVED = "RESOLVED", "AMBIGUOUS", "UNRESOLVED"
_EVER = 1 << 60


def _number(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _marks(claims: DataFrame, devices: DataFrame) -> DataFrame:
    """Where claims begin and end: ``__address, __at, __n, __d``."""
    valid = claims.where(F.col("address").isNotNull() & F.col("device_id").isNotNull()).where(
        F.col("valid_to_us").isNull() | F.col("valid_from_us").isNull() | (F.col("valid_from_us") < F.col("valid_to_us"))
    )
    start = F.struct(F.coalesce("valid_from_us", F.lit(-_EVER)).cast("bigint").alias("at"), F.lit(1).alias("n"))
    end = F.struct(F.col("valid_to_us").cast("bigint").alias("at"), F.lit(-1).alias("n"))
    return (
        valid.join(devices, "device_id")
        .select(F.col("address").alias("__address"), "__d", F.explode(F.array(start, end)).alias("m"))
        .where("m.at IS NOT NULL")
        .select("__address", "__d", F.col("m.at").alias("__at"), F.col("m.n").alias("__n"))
    )


def _devices(claims: DataFrame) -> DataFrame:
    """Every device with a number; written once, so that the numbers stay.

    Numbers are dealt row by row over the partitions in turn, so they are hardly larger than the
    number of devices and their squares' sums fit.
    """
    known = claims.select("device_id").where(F.col("device_id").isNotNull()).distinct()
    dealt = materialise(known.withColumn("id", F.monotonically_increasing_id()))
    part, row = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    parts = (dealt.agg(F.max(part)).first()[0] or 0) + 1
    return dealt.select("device_id", (row * parts + part + 1).alias("__d"))


def _sums() -> dict[str, Column]:
    n, d = _number(F.coalesce("__n", F.lit(0))), _number(F.coalesce("__d", F.lit(0)))
    return {"__claims": n, "__sum": _number(n * d), "__squares": _number(n * d * d)}


def _one_device(claims: Column, total: Column, squares: Column) -> Column:
    return _number(claims * squares) == _number(total * total)


def resolve_devices(
    observations: DataFrame, claims: DataFrame, address: str, ts_us: str, bucket_us: int = DAY_US
) -> DataFrame:
    """All observations with ``resolved_device``, ``n_claims`` and ``identity_status`` at their instant.

    ``claims``: ``address, device_id, valid_from_us, valid_to_us``; a claim holds from its start up to,
    not including, its end. A null start means since ever, a null end until further notice; claims
    that end before they begin, or without address or device, count for nothing, repeated claims each
    count. RESOLVED: all claims that hold are of one device; AMBIGUOUS: of several, and no device is
    named; UNRESOLVED: none holds. Observations of a null address or instant are unresolved; all rows
    stay.
    """
    devices = _devices(claims)
    seen = observations.withColumns(
        {"__address": F.col(address), "__at": F.col(ts_us).cast("bigint"), "__kind": F.lit(1)}
    )
    rows = seen.unionByName(_marks(claims, devices).withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    along = running(rows, ["__address"], "__at", ["__at", "__kind"], _sums(), bucket_us=bucket_us)
    claims_, total, squares = (F.coalesce(c, _number(F.lit(0))) for c in ("__claims", "__sum", "__squares"))
    status = (
        F.when(claims_ == 0, UNRESOLVED).when(_one_device(claims_, total, squares), RESOLVED).otherwise(AMBIGUOUS)
    )
    found = along.where("__kind = 1").select(
        *[F.col(f"`{c}`") for c in observations.columns],
        claims_.cast("bigint").alias("n_claims"),
        status.alias("identity_status"),
        F.when(status == RESOLVED, F.try_divide(total, claims_).cast("bigint")).alias("__d"),
    )
    named = devices.withColumnRenamed("device_id", "resolved_device")
    return found.join(named, "__d", "left").drop("__d")


def conflicting_claims(claims: DataFrame, bucket_us: int = DAY_US) -> DataFrame:
    """Stretches of time in which several devices claim an address: ``address, from_us, to_us, n_claims``.

    A stretch ends where any claim on the address begins or ends. Null ``from_us`` and ``to_us``: since
    ever, until further notice. See ``resolve_devices`` for the claims that count.
    """
    marks = _marks(claims, _devices(claims))
    last = marks.select("__address").distinct().withColumns({"__at": F.lit(_EVER), "__n": F.lit(0), "__d": F.lit(0)})
    own = _sums()
    steps = marks.unionByName(last).groupBy("__address", "__at").agg(*[F.sum(c).alias(f"own{k}") for k, c in own.items()])
    along = running(
        steps,
        ["__address"],
        "__at",
        ["__at"],
        {k: _number(F.col(f"own{k}")) for k in own},
        {"__from": F.col("__at")},
        bucket_us,
    )
    # What held up to a mark is what the sums were without it.
    held = {k: _number(F.col(k) - F.col(f"own{k}")) for k in own}
    many = ~_one_device(*held.values()) & (held["__claims"] > 0)
    return along.where(many).select(
        F.col("__address").alias("address"),
        F.when(F.col("__from") > -_EVER, F.col("__from")).alias("from_us"),
        F.when(F.col("__at") < _EVER, F.col("__at")).alias("to_us"),
        held["__claims"].cast("bigint").alias("n_claims"),
    )
