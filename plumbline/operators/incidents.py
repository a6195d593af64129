"""Life cycle of alerts and their grouping into incidents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.timing import micros, to_micros
from plumbline.sources.store import stored

_KEYS = ("source", "event_type")
_OF_KEYS = {k: k for k in _KEYS}


def _beside(rows: DataFrame, other: DataFrame, on: dict[str, Column | str], how: str = "inner") -> DataFrame:
    """Join other to rows where its columns equal those expressions of rows, nulls too; the columns joined on go."""
    renamed = other.withColumnsRenamed({name: f"of_{name}" for name in on})
    same = reduce(lambda x, y: x & y, [(F.col(value) if isinstance(value, str) else value).eqNullSafe(F.col(f"of_{name}")) for name, value in on.items()])
    return rows.join(renamed, same, how).drop(*[f"of_{name}" for name in on])


def _jumps(times: DataFrame, size: int) -> DataFrame:
    """times (source, event_type, at) with seed (no time of the key in the `size` before) and next: the first time `size` or more after.

    Time is cut into stretches of that size. The next one lies in the following stretch, at the same place or
    behind, or is the first of the stretches after; so all that a key needs in one place is a row a stretch.
    """
    cut = times.withColumn("stretch", F.floor(F.col("at") / size))
    ends = cut.groupBy(*_KEYS, "stretch").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    along = Window.partitionBy(*_KEYS).orderBy("stretch")
    pause = F.coalesce(F.col("first") - F.lag("last").over(along) >= size, F.lit(True))
    following = [F.lead(F.struct("stretch", "first"), k).over(along).alias(f"after{k}") for k in (1, 2)]
    ends = ends.select(*_KEYS, "stretch", "first", pause.alias("pause"), *following)
    probes = cut.select(*_KEYS, (F.col("stretch") + 1).alias("stretch"), (F.col("at") + size).alias("place"), F.lit(1).alias("probe"), "at")
    both = cut.select(*_KEYS, "stretch", F.col("at").alias("place"), F.lit(0).alias("probe"), "at").unionByName(probes)
    down = Window.partitionBy(*_KEYS, "stretch").orderBy(F.desc("place"), "probe").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("met", F.min(F.when(F.col("probe") == 0, F.col("at"))).over(down)).where("probe = 1")
    met = met.withColumn("stretch", F.col("stretch") - 1)
    joined = _beside(met, ends, {c: F.col(c) for c in (*_KEYS, "stretch")})
    near = F.col("after1.stretch") == F.col("stretch") + 1
    behind = F.when(near, F.col("after2.first")).otherwise(F.col("after1.first"))
    return joined.select(*_KEYS, "at", (F.col("pause") & (F.col("at") == F.col("first"))).alias("seed"), F.coalesce("met", behind).alias("next"))


def _openings(times: DataFrame, size: int) -> DataFrame:
    """(source, event_type, at): the times at which incidents open.

    From each seed on, every opening is the next one of the opening before. Pointers over one, four, sixteen
    ... openings mark them all after a number of rounds that grows with the logarithm of a burst.
    """
    jumps = stored(_jumps(times, size))
    seeds = jumps.where("seed").select(*_KEYS, "at")
    known = seeds
    hop = _beside(jumps.where("next IS NOT NULL").select(*_KEYS, "at", "next"), seeds.withColumn("known", F.lit(True)), {**_OF_KEYS, "at": F.col("next")}, "left")
    hop = stored(hop.where("known IS NULL").drop("known"))  # a burst ends where the next one is a seed itself
    while not hop.isEmpty():
        for _ in range(2):
            reached = _beside(known, hop, {**_OF_KEYS, "at": F.col("at")}).select(*_KEYS, F.col("next").alias("at"))
            known = known.unionByName(reached)
            ahead = hop.withColumnRenamed("next", "far")
            hop = _beside(hop, ahead, {**_OF_KEYS, "at": F.col("next")}).select(*_KEYS, "at", F.col("far").alias("next"))
        known, hop = stored(known), stored(hop)
    return known


def correlate(alerts: DataFrame, window: float) -> DataFrame:
    """Add incident_start: when the incident of each alert was opened.

    An alert joins the incident of its source and type that was opened less than `window` seconds before,
    else it opens one; joining does not prolong it. Openings are at least a window apart, so the one of an
    alert is in its own stretch of that length or in the one before.
    """
    size = to_micros(window)
    times = alerts.select(*_KEYS, micros(F.col("created_at")).alias("at")).distinct()
    opened = _openings(times, size).select(*_KEYS, F.floor(F.col("at") / size).alias("stretch"), F.col("at").alias("opened"))
    rows = alerts.withColumn("__at", micros(F.col("created_at"))).withColumn("__stretch", F.floor(F.col("__at") / size))
    for back in (0, 1):
        rows = _beside(rows, opened.withColumnRenamed("opened", f"__opened{back}"), {**_OF_KEYS, "stretch": F.col("__stretch") - back}, "left")
    start = F.when(F.col("__opened0") <= F.col("__at"), F.col("__opened0")).otherwise(F.col("__opened1"))
    shifted = F.timestamp_add("MICROSECOND", start - F.col("__at"), F.col("created_at"))
    return rows.withColumn("incident_start", shifted).drop("__at", "__stretch", "__opened0", "__opened1")


def incidents(correlated: DataFrame) -> DataFrame:
    """One row for each incident: title, source, event_type, created_at, alerts, status. Ties go by alert type."""
    first = F.min_by("alert_type", F.struct("created_at", "alert_type"))
    rows = correlated.groupBy("source", "event_type", "incident_start").agg(first.alias("first_type"), F.count("*").alias("alerts"))
    return rows.select(
        F.concat("first_type", F.lit(" on "), "source").alias("title"), "source", "event_type", F.col("incident_start").alias("created_at"),
        "alerts", F.lit("OPEN").alias("status"),
    )


def attach(alerts: DataFrame, open_before: DataFrame, window: float) -> tuple[DataFrame, DataFrame]:
    """(alerts with incident_id, the incidents that they open), going on from incidents that are open already.

    open_before: id, source, event_type and created_at of incidents, of which those opened last go on. The id of an
    incident is that of the alert that opens it, so it is the same when a batch comes again. alerts: id, alert_type,
    source, event_type and created_at, none of which came before the incidents carried over.
    """
    last = open_before.groupBy(*_KEYS).agg(F.max_by(F.struct("id", "created_at"), F.struct("created_at", "id")).alias("l"))
    carried = last.select(*_KEYS, "l.created_at", F.col("l.id").alias("__carried"))
    rows = alerts.drop("incident_id").withColumn("__carried", F.lit(None).cast("long"))
    # alerts go as they are through joins with the few openings and incidents, and are not joined to themselves
    found = correlate(rows.unionByName(carried, allowMissingColumns=True), window)
    opening = F.when(F.col("id").isNotNull(), F.struct("created_at", "alert_type", "id"))
    groups = found.groupBy(*_KEYS, "incident_start").agg(F.max("__carried").alias("carried"), F.min(opening).alias("first"))
    groups = stored(groups.withColumn("incident_id", F.coalesce("carried", "first.id")))
    new = groups.where("carried IS NULL").select(
        F.col("incident_id").alias("id"), F.concat("first.alert_type", F.lit(" on "), "source").alias("title"), F.lit("OPEN").alias("status"),
        *_KEYS, F.col("incident_start").alias("created_at"),
    )
    of = groups.select(*_KEYS, "incident_start", "incident_id")
    named = _beside(found.where("id IS NOT NULL"), of, {c: F.col(c) for c in (*_KEYS, "incident_start")})
    return named.drop("__carried", "incident_start"), new


def apply_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts after actions (id, action, at, by, root_cause): 'acknowledge' or 'resolve'; of each kind the last counts.

    Any order of states is accepted; the last action decides the status. Acknowledging without a name is by
    'anonymous'; resolving without a cause leaves an empty one. Actions on unknown alerts have no effect.
    """
    last = actions.groupBy(F.col("id").alias("of_id")).agg(
        F.max_by("action", F.struct("at", "action")).alias("last_action"),
        F.max_by(F.struct("at", F.coalesce("by", F.lit("anonymous")).alias("by")), F.when(F.col("action") == "acknowledge", F.col("at"))).alias("ack"),
        F.max_by(F.struct("at", F.coalesce("root_cause", F.lit("")).alias("cause")), F.when(F.col("action") == "resolve", F.col("at"))).alias("res"),
        F.bool_or(F.col("action") == "acknowledge").alias("has_ack"),
        F.bool_or(F.col("action") == "resolve").alias("has_res"),
    )
    state = F.when(F.col("last_action") == "acknowledge", F.lit("ACKNOWLEDGED")).when(F.col("last_action") == "resolve", F.lit("RESOLVED"))
    acknowledged, resolved = F.col("has_ack"), F.col("has_res")
    kept = [c for c in alerts.columns if c not in ("status", "acknowledged_by", "acknowledged_at", "root_cause", "resolved_at")]
    joined = alerts.join(last, F.col("id") == F.col("of_id"), "left")
    return joined.select(
        *kept,
        F.coalesce(state, F.lit("OPEN")).alias("status"),
        F.when(acknowledged, F.col("ack.by")).alias("acknowledged_by"),
        F.when(acknowledged, F.col("ack.at")).alias("acknowledged_at"),
        F.when(resolved, F.col("res.cause")).alias("root_cause"),
        F.when(resolved, F.col("res.at")).alias("resolved_at"),
    )


def resolve_incident(table: DataFrame, incident_id: int, at: Column) -> DataFrame:
    """The incidents with one resolved; its alerts stay as they are."""
    own = F.col("id") == incident_id
    done = F.when(own, F.lit("RESOLVED")).otherwise(F.col("status"))
    return table.withColumn("status", done).withColumn("resolved_at", F.when(own, at).otherwise(F.col("resolved_at")))


def stats(table: DataFrame) -> DataFrame:
    """One row: total, open, acknowledged and resolved."""
    of = lambda state: F.count_if(F.col("status") == state)
    return table.agg(
        F.count("*").alias("total"), of("OPEN").alias("open"), of("ACKNOWLEDGED").alias("acknowledged"), of("RESOLVED").alias("resolved")
    )
