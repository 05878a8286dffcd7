"""The processing queue as a stream: keyed retry state, and a loader that makes each micro-batch idempotent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import MAX_RETRIES, STATUS
from ..sources.snapshot import SnapshotStore

OUTPUT = "group_id string, episode_uuid string, status string, retry_count int"


def retry_states(events: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """(group_id, episode_uuid, status, retry_count) after each micro-batch of ``events(group_id, episode_uuid, ts, seq, event)``.

    State per entry is a status and a counter. Events of one batch are applied in the order of (ts, seq). Nothing expires:
    state leaves only with a delete event, and late events count like others.
    """

    def apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, count = state.get if state.exists else ("pending_nodes", 0)
        for _, event in pd.concat(list(frames)).sort_values(["ts", "seq"])["event"].items():  # events of one entry
            if event == "fail":
                count = min(count + 1, max_retries)
                status = "dead" if count >= max_retries else "pending_nodes"
            else:
                status, count = STATUS.get(event, status), 0
        if status == "deleted":
            state.remove()
        else:
            state.update((status, count))
        yield pd.DataFrame({"group_id": [key[0]], "episode_uuid": [key[1]], "status": [status], "retry_count": [count]})

    return events.groupBy("group_id", "episode_uuid").applyInPandasWithState(apply, OUTPUT, "status string, retry_count int", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there and stop."""
    query = stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def keep_latest(store: SnapshotStore, name: str) -> Callable[[DataFrame, int], None]:
    """A batch function that adds the changed states of a batch to a versioned table; ``latest`` reads it.

    A batch writes only its own rows. Folders are put together by the store once there are many, so a row is rewritten
    once in that many batches.
    """

    def each(batch: DataFrame, number: int) -> None:
        store.commit(str(number), more={name: batch.withColumn("batch", F.lit(number).cast("bigint"))})

    return each


def latest(store: SnapshotStore, name: str) -> DataFrame:
    """(group_id, episode_uuid, status, retry_count) as of the last batch; deleted entries leave."""
    keys = ["group_id", "episode_uuid"]
    newest = store.read(name).groupBy(*keys).agg(F.max_by(F.struct("status", "retry_count"), "batch").alias("x"))
    return newest.select(*keys, "x.status", "x.retry_count").where(F.col("status") != "deleted")


def ingest(store: SnapshotStore, process: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A batch function for new entries: adds those not yet there, runs ``process`` on them and adds its rows to their tables.

    What is new is told from the tables before the batch, and all tables change in one swap of the pointer: a batch that
    failed anywhere is repeated in full, one that was applied changes nothing, and nothing is doubled or lost. Rows
    without a uuid are refused by ``load_entries`` before; here they leave. Of copies of an entry in a batch the
    smallest content stays.
    """

    def each(batch: DataFrame, number: int) -> None:
        if store.batch() == str(number):
            return
        rest = [c for c in batch.columns if c not in ("group_id", "uuid")]
        new = batch.where("group_id IS NOT NULL AND uuid IS NOT NULL")
        order = F.to_json(F.struct(*rest)) if rest else F.lit("")
        new = new.groupBy("group_id", "uuid").agg(F.min_by(F.struct(*batch.columns), order).alias("x")).select("x.*")
        new = store.missing(new, "episodes", ["group_id", "uuid"])
        store.commit(str(number), more={"episodes": new, **process(new)})

    return each
