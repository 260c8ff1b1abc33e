"""A work queue in a keyed table: requests are claimed under the version that was read, so no two workers have one, and a crashed worker's come back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.keyed import KeyedTable, Overtaken


class Queue:
    """Requests (id, status, requested_at, worker, claimed_at, attempts, processed_at, error_message).

    pending requests, and those claimed longer than lease ago (their worker crashed), are handed out by requested_at and id (nulls first); one that
    was handed out most times without an end fails.
    """

    def __init__(self, table: KeyedTable, lease: str = "10 minutes", most: int = 3) -> None:
        self.table, self.lease, self.most = table, lease, most

    def put(self, requests: DataFrame) -> int:
        """Adds requests (id, requested_at) as pending ones."""
        none = {"worker": "string", "claimed_at": "timestamp_ntz", "processed_at": "timestamp_ntz", "error_message": "string"}
        rows = requests.select("id", F.lit("pending").alias("status"), "requested_at", F.lit(0).alias("attempts"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
        return self.table.merge(rows)

    def claim(self, worker: str, n: int, now: Column) -> DataFrame | None:
        """The next n requests, claimed by the worker; None if none is to be had. Tried again on the newest version while other workers are first."""
        while True:
            version = self.table.version().number
            rows = self.table.read(version)
            late = (F.col("status") == "processing") & (F.col("claimed_at") < now - F.expr(f"INTERVAL {self.lease}"))
            worn = late & (F.col("attempts") >= self.most)
            free = rows.filter((F.col("status") == "pending") | late).orderBy(worn, F.asc_nulls_first("requested_at"), "id").limit(n)
            taken = free.select(
                "id", F.when(worn, "failed").otherwise("processing").alias("status"), F.lit(worker).alias("worker"), now.alias("claimed_at"), (F.col("attempts") + F.when(worn, 0).otherwise(1)).alias("attempts"),
                F.when(worn, now).alias("processed_at"), F.when(worn, "given up").alias("error_message"),
            )
            if taken.isEmpty():
                return None
            try:
                self.table.merge(taken, expect=version)
            except Overtaken:
                continue
            # of the version read, which stays as it is: just the requests of this claim
            return taken.filter("status = 'processing'").select("id", "attempts").join(rows.select("id", "requested_at"), "id")

    def finish(self, worker: str, results: DataFrame, now: Column) -> int:
        """Records results (id, error: null if all went well) of requests that the worker still holds; others are no longer its own."""
        while True:
            version = self.table.version().number
            held = self.table.read(version).filter((F.col("worker") == worker) & (F.col("status") == "processing")).select("id")
            ended = results.join(held, "id", "left_semi").select("id", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), now.alias("processed_at"), F.col("error").alias("error_message"))
            try:
                return self.table.merge(ended, expect=version)
            except Overtaken:
                continue


def worked(queue: Queue, worker: str, n: int, work: Callable[[DataFrame], DataFrame], clock: Column) -> int:
    """Claims n requests at a time at the clock's time and records what work (id to id and error) says of them, until none is left; the number of claims."""
    claims = 0
    while (mine := queue.claim(worker, n, clock)) is not None:
        queue.finish(worker, work(mine.select("id")), clock)
        claims += 1
    return claims
