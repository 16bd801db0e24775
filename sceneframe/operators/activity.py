"""Runs as told by their events: refusals, answers, failures and what was used last.

Events carry ``run_id, event_id, at``; ``refused`` and ``answered`` are made by ``service_events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneframe import constants as C
from sceneframe.functions.naming import any_contains
from sceneframe.functions.settle import settle
from sceneframe.functions.text import SPACES
from sceneframe.operators.ordered import numbered, scan


def classify(outputs: DataFrame) -> DataFrame:
    """Add ``fault`` (permanent or transient), ``refusal``, ``lost_network`` and ``stale_tool``.

    Takes ``output``, the whole error text of a tool; only its last line decides.
    """
    bare = F.regexp_replace("output", f"[{SPACES}]+$", "")
    last = F.trim(F.element_at(F.split(bare, "\n"), -1))
    d = settle(outputs, {"line": last})
    d = settle(d, {"_before": F.regexp_replace("line", "(?s)url=.*$", "")})
    line, before = F.col("line"), F.col("_before")
    handshake = line.contains("WSServerHandshakeError") | line.contains("InvalidStatus")
    stale = handshake & (before.contains("403") | before.contains("401"))
    fault = (
        F.when(any_contains(line, C.PERMANENT_MARKERS), "permanent").when(stale, "permanent")
        .when(any_contains(line, C.TRANSIENT_MARKERS), "transient")
        .when(before.contains("429") | before.contains("503"), "transient").otherwise("permanent")
    )
    proxy = line.contains("ClientProxyConnectionError")
    turned_away = ~line.contains("ClientConnectorDNSError") & ~proxy & (
        line.contains("Connect call failed") | line.contains("ConnectionRefusedError"))
    unconnected = line.contains("ConnectionTimeoutError") | line.contains("Connection timeout to host")
    return d.withColumns({
        "fault": fault,
        "refusal": turned_away | before.contains("429") | unconnected,
        "lost_network": ~proxy & any_contains(line, C.NETWORK_MARKERS),
        "stale_tool": stale,
    }).drop("_before")


def cooldown(k: Column) -> Column:
    """Seconds to wait after the k-th refusal of a streak."""
    return F.least(F.lit(C.COOLDOWN_SECONDS) * F.pow(F.lit(2), F.least(k - 1, F.lit(10))), F.lit(C.MAX_COOLDOWN_SECONDS)).cast("bigint")


def total_cooldown(n: Column) -> Column:
    """Sum of the first ``n`` cooldowns: 15, 30, 60, then 120 each."""
    return (
        F.when(n <= 3, F.lit(C.COOLDOWN_SECONDS) * (F.pow(F.lit(2), n) - 1))
        .otherwise(7 * C.COOLDOWN_SECONDS + (n - 3) * C.MAX_COOLDOWN_SECONDS).cast("bigint")
    )


def streaks(service: DataFrame) -> DataFrame:
    """Refusals between two answers, one row per streak: gaps and islands.

    ``service``: ``run_id, event_id, at, refused, answered``. ``island`` is the number of
    answers before the streak.
    """
    told = service.filter("refused OR answered").withColumn("_one", F.when(F.col("answered"), 1).otherwise(0))
    run = scan(told, ["run_id"], ["at", "event_id"], sums={"island": "_one"})
    return run.filter("refused").groupBy("run_id", "island").agg(
        F.min("at").alias("started"), F.max("at").alias("ended"), F.count(F.lit(1)).alias("refusals"))


def finished(streaks_: DataFrame) -> DataFrame:
    """Cooldowns and patience of streaks: ``spoken_any`` says whether the run was ever answered."""
    patience = F.when(F.col("spoken_any"), C.PATIENCE_SECONDS).otherwise(C.PATIENCE_COLD_SECONDS)
    lasted = F.unix_micros("ended") - F.unix_micros("started")
    return streaks_.withColumns({
        "last_wait": cooldown(F.col("refusals")), "waited": total_cooldown(F.col("refusals")),
        "gave_up": lasted >= patience.cast("bigint") * 1_000_000,
    })


def throttle_episodes(service: DataFrame) -> DataFrame:
    """Every streak of refusals as a numbered episode of its run."""
    found = numbered(streaks(service), ["run_id"], ["island"], "episode")
    return finished(found.withColumn("spoken_any", F.col("island") > 0)).drop("island")


def answered_within(service: DataFrame, seconds: int) -> DataFrame:
    """Whether the run was answered in the last ``seconds`` before each event, itself included.

    The latest answer so far decides, so a running maximum does what a range frame would.
    """
    told = service.withColumn("_answer", F.when(F.col("answered"), F.col("at")))
    run = scan(told, ["run_id"], ["at", "event_id"], maxes={"last_answer": "_answer"})
    since = F.unix_micros("at") - F.unix_micros("last_answer")
    return run.withColumn("recent", F.coalesce(since < seconds * 1_000_000, F.lit(False))).drop("_answer")


def run_outcomes(outcomes: DataFrame) -> DataFrame:
    """Per run: done, failed, not started, and the first failure. Takes ``outcome, scene``."""
    failed = F.col("outcome") == "failed"
    return outcomes.groupBy("run_id").agg(
        F.count_if(F.col("outcome") == "done").alias("done"),
        F.count_if(failed).alias("failed"),
        F.count_if(F.col("outcome") == "not_started").alias("not_started"),
        F.min(F.when(failed, F.col("scene"))).alias("first_failure"),
    )


def run_failures(outcomes: DataFrame) -> DataFrame:
    """Every failure of a run with its detail, numbered in scene order. Takes ``scene, outcome, detail``.

    A cancelled run's failures are kept too; ``run_outcomes`` counts what was not started.
    """
    failed = outcomes.filter("outcome = 'failed'").select("run_id", "scene", "detail")
    return numbered(failed, ["run_id"], ["scene", "detail"], "nth")


def recent_projects(uses: DataFrame, limit: int = C.RECENT_PROJECTS) -> DataFrame:
    """The projects used last, latest first. Takes ``path, name, at``."""
    latest = uses.groupBy("path").agg(F.max_by("name", F.struct("at", "name")).alias("name"), F.max("at").alias("at"))
    return latest.orderBy(F.desc("at"), "path").limit(limit)
