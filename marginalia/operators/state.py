"""Processing state of entries: status, retries, dead letters, queues, and the two small state machines of the screen.

Batch form over event tables; ``streaming.queue`` keeps the same state continuously.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_RETRIES = 3
# Poll intervals in seconds by state of the machine.
POLL = {"active": 0.3, "queued": 0.5, "idle": 2.0}
STATUS = {"enqueue": "pending_nodes", "ok": "done", "retry": "pending_nodes", "delete": "deleted"}


def replay(events: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """(group_id, episode_uuid, status, retry_count) after all of ``events(group_id, episode_uuid, ts, seq, event)``.

    enqueue and retry start anew with no retries; fail counts and ends in dead at ``max_retries``; ok ends in done. Failures are
    counted since the last event that resets them, with two aggregates instead of a sorted replay of a key's history.
    """
    order = F.struct("ts", "seq")
    keys = ["group_id", "episode_uuid"]
    resets = events.where("event <> 'fail'").groupBy(*keys).agg(F.max(order).alias("reset"), F.max_by("event", order).alias("last"))
    joined = events.join(resets, keys, "left")
    fails = joined.groupBy(*keys).agg(F.sum(((F.col("event") == "fail") & (F.col("reset").isNull() | (order > F.col("reset")))).cast("int")).alias("fails"), F.max("last").alias("last"))
    names = F.create_map(*[F.lit(x) for p in STATUS.items() for x in p])
    status = F.when(F.col("fails") >= max_retries, "dead").when(F.col("fails") > 0, "pending_nodes").otherwise(F.coalesce(F.try_element_at(names, F.col("last")), F.lit("pending_nodes")))
    return fails.select(*keys, status.alias("status"), F.least("fails", F.lit(max_retries)).alias("retry_count"))


def pending(state: DataFrame, entries: DataFrame, most: int | None = None) -> DataFrame:
    """(group_id, episode_uuid, score): waiting entries, newest first; equal scores by key, largest first."""
    waiting = state.where("status = 'pending_nodes'").join(entries.select("group_id", F.col("uuid").alias("episode_uuid"), (F.unix_micros("valid_at") / 1e6).alias("score")), ["group_id", "episode_uuid"])
    out = waiting.select("group_id", "episode_uuid", "score").orderBy(F.desc("score"), F.desc("episode_uuid"))
    return out.limit(most) if most else out


def by_status(state: DataFrame) -> DataFrame:
    """(group_id, status, entries)."""
    return state.groupBy("group_id", "status").agg(F.count("*").alias("entries"))


def revive_dead(state: DataFrame, entries: DataFrame, active: DataFrame) -> DataFrame:
    """State after retrying dead letters: dead entries wait again unless active; those without an entry leave."""
    live = entries.select("group_id", F.col("uuid").alias("episode_uuid"), F.lit(True).alias("_live"))
    busy = active.select("group_id", "episode_uuid", F.lit(True).alias("_busy"))
    joined = state.join(live, ["group_id", "episode_uuid"], "left").join(busy, ["group_id", "episode_uuid"], "left")
    again = (F.col("status") == "dead") & F.col("_busy").isNull()
    kept = joined.where(~(again & F.col("_live").isNull()))
    return kept.select("group_id", "episode_uuid", F.when(again, "pending_nodes").otherwise(F.col("status")).alias("status"), F.when(again, 0).otherwise(F.col("retry_count")).alias("retry_count"))


def without_entries(state: DataFrame, entries: DataFrame) -> DataFrame:
    """State rows whose entry is gone."""
    return state.join(entries.select("group_id", F.col("uuid").alias("episode_uuid")), ["group_id", "episode_uuid"], "left_anti")


def pop(queue: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """(taken, left): the first ``count`` of each journal by ``seq``, and the rest."""
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy("seq"))
    taken = queue.withColumn("_r", rank).where(F.col("_r") <= count).drop("_r")
    return taken, queue.join(taken.select("group_id", "seq"), ["group_id", "seq"], "left_anti")


def task_order(tasks: DataFrame) -> DataFrame:
    """Tasks by priority, larger first, then by arrival; one task an entry."""
    first = Window.partitionBy("group_id", "episode_uuid").orderBy(F.desc("priority"), "seq")
    return tasks.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").orderBy(F.desc("priority"), "seq")


def snapshot(state: DataFrame, entries: DataFrame, control: DataFrame) -> DataFrame:
    """One row a journal: active entry, waiting, model state, enabled, blocked, retry of the active entry or else of the first in the queue.

    ``control(group_id, active_uuid, model_state, inference_enabled, blocked)`` holds the switches; missing ones have defaults.
    """
    queue = pending(state, entries).groupBy("group_id").agg(F.count("*").alias("pending_count"), F.max_by("episode_uuid", F.struct("score", "episode_uuid")).alias("_head"))
    out = control.join(queue, "group_id", "left").withColumn("_look", F.coalesce("active_uuid", "_head"))
    retries = state.select("group_id", F.col("episode_uuid").alias("_look"), "retry_count")
    out = out.join(retries, ["group_id", "_look"], "left")
    return out.select(
        "group_id", "active_uuid", F.coalesce("pending_count", F.lit(0)).alias("pending_count"), F.coalesce("model_state", F.lit("idle")).alias("model_state"),
        F.coalesce("inference_enabled", F.lit(True)).alias("inference_enabled"), F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce("retry_count", F.lit(0)).alias("retry_count"), F.lit(MAX_RETRIES).alias("max_retries"),
    )


def display(model_state: Column, pending_count: Column, active: Column) -> Column:
    """struct(busy, waiting, poll_seconds) of the processing indicator."""
    busy = model_state.isin("loading", "inferring", "unloading") | active.isNotNull()
    waiting = ~busy & (pending_count > 0)
    poll = F.when(busy, POLL["active"]).when(waiting, POLL["queued"]).otherwise(POLL["idle"])
    return F.struct(busy.alias("busy"), waiting.alias("waiting"), poll.alias("poll_seconds"))


# States and events of the side panel.
PANEL_STATES = ["hidden", "disabled", "processing_nodes", "awaiting_edges", "ready_entities", "empty_idle"]
PANEL_EVENTS = [
    "show", "hide", "episode_closed", "inference_disabled", "inference_enabled", "status_pending_nodes", "status_pending_edges_or_done", "cache_entities_found", "cache_empty", "user_deleted_entity",
]


def _panel_step(acc: Column, x: Column) -> Column:
    """The panel after an event: (state, status, enabled, present). An event that its state does not allow changes nothing."""
    now, event = acc["state"], x["event"]
    status, enabled, present = (F.coalesce(x[c], acc[c]) for c in ("status", "enabled", "present"))
    ready = (status.isNull() | (status == "done")) & present
    opened = F.when(status == "pending_nodes", "processing_nodes").when(status == "pending_edges", "awaiting_edges").when(ready, "ready_entities").otherwise("empty_idle")
    shown, working = now != "hidden", ~now.isin("disabled")
    after = (
        F.when(event == "show", F.when(shown, now).when(~enabled, "disabled").otherwise(opened))
        .when(event.isin("hide", "episode_closed"), F.when(shown, F.lit("hidden")))
        .when(event == "inference_disabled", F.when(working, F.lit("disabled")))
        .when(event == "inference_enabled", F.when(~working, opened))
        .when(event == "status_pending_nodes", F.when(working, F.lit("processing_nodes")))
        .when(event == "status_pending_edges_or_done", F.when(now == "processing_nodes", F.when(status == "pending_edges", "awaiting_edges").when(ready, "ready_entities").otherwise("empty_idle")).when(now == "awaiting_edges", F.when(ready, "ready_entities").otherwise("empty_idle")).when(working, now))
        .when(event == "cache_entities_found", F.when(working, F.lit("ready_entities")))
        .when(event == "cache_empty", F.when(working, F.lit("empty_idle")))
        .when(event == "user_deleted_entity", F.when((now == "ready_entities") & ~present, F.lit("empty_idle")).when(now.isin("ready_entities", "empty_idle"), now))
    )
    allowed = after.isNotNull()
    keeps = event.isin("hide", "episode_closed", "inference_disabled")
    status = F.when(~allowed | keeps, acc["status"]).when(event == "status_pending_nodes", F.lit("pending_nodes")).when((event == "user_deleted_entity") & x["status"].isNull() & (x["present"] == F.lit(False)), F.lit(None)).otherwise(status)
    enabled = F.when(~allowed, acc["enabled"]).when(event == "inference_disabled", F.lit(False)).when(event == "inference_enabled", F.lit(True)).when(event == "show", enabled).otherwise(acc["enabled"])
    present = F.when(~allowed | keeps, acc["present"]).when(event == "cache_entities_found", F.lit(True)).when(event == "cache_empty", F.lit(False)).otherwise(present)
    return F.struct(F.coalesce(after, now).alias("state"), status.cast("string").alias("status"), enabled.alias("enabled"), present.alias("present"))


def panel_states(events: DataFrame) -> DataFrame:
    """(key, state, status): the side panel after the ``events(key, seq, event, status, enabled, present)`` of each key in order.

    A null status, enabled or present says that the event does not carry it. A panel begins hidden, enabled, without status and entities.
    """
    listed = events.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "event", "status", "enabled", "present"))).alias("l"))  # events of one screen
    begin = F.struct(F.lit("hidden").alias("state"), F.lit(None).cast("string").alias("status"), F.lit(True).alias("enabled"), F.lit(False).alias("present"))
    return listed.select("key", F.aggregate("l", begin, _panel_step).alias("x")).select("key", "x.state", "x.status")
