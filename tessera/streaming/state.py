"""Streams whose result depends on what came before: chunks put together to lines, keys that expire, harvests that stop."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.keyed import KeyedTable
from tessera.streaming.pipelines import scratch

#: Chunks of a connection whose line feeds one window adds up.
SPAN = 1_000
#: The last line of a connection.
END = "data: [DONE]"


def lines_of(chunks: DataFrame, connection: str = "connection", place: str = "place", chunk: str = "chunk") -> DataFrame:
    """connection, line (from 0), text of each line that its line feed has ended, of chunks cut anywhere, in order of place.

    Line feeds are added up by runs of SPAN places and then over the runs, so a connection with most of all chunks is many small windows; a line is put together where its
    pieces meet. A null chunk is empty; what follows a connection's last line feed isn't a line yet; a carriage return before a line feed is dropped.
    """
    held = chunks.select(F.col(connection).alias("connection"), F.col(place).cast("bigint").alias("place"), F.split(F.coalesce(chunk, F.lit("")), "\n", -1).alias("pieces"))
    placed = held.withColumns({"run": F.floor(F.col("place") / SPAN), "feeds": F.size("pieces") - 1})
    runs = placed.groupBy("connection", "run").agg(F.sum("feeds").alias("feeds"))
    before = W.partitionBy("connection").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    first = runs.select("connection", "run", F.coalesce(F.sum("feeds").over(before), F.lit(0)).alias("first"))
    inside = W.partitionBy("connection", "run").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    numbered = placed.withColumn("inside", F.coalesce(F.sum("feeds").over(inside), F.lit(0))).join(first.withColumnRenamed("connection", "_c").withColumnRenamed("run", "_r"), F.col("connection").eqNullSafe(F.col("_c")) & F.col("run").eqNullSafe(F.col("_r")))
    pieces = numbered.select("connection", "place", (F.col("first") + F.col("inside")).alias("line"), "feeds", F.posexplode("pieces").alias("at", "piece"))
    ended = F.max((F.col("at") < F.col("feeds")).cast("int")) == 1
    joined = pieces.withColumn("line", (F.col("line") + F.col("at")).cast("bigint")).groupBy("connection", "line").agg(ended.alias("ended"), F.array_sort(F.collect_list(F.struct("place", "at", "piece"))).alias("p"))
    return joined.filter("ended").select("connection", "line", F.regexp_replace(F.array_join(F.transform("p", lambda x: x["piece"]), ""), "\r$", "").alias("text"))


def lines_stream(chunks: DataFrame) -> DataFrame:
    """The same of a stream of chunks (connection string, place long, chunk string): each connection's state holds its open line, and chunks that came too early.

    Chunks count from place 0; one that comes twice is dropped. A connection is forgotten after its end mark (the line ``data: [DONE]``).
    """

    def feed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, line, rest, early = state.get if state.exists else (0, 0, "", "{}")
        waiting = {int(k): v for k, v in json.loads(early).items()}
        for batch in batches:
            waiting.update((int(p), c or "") for p, c in zip(batch["place"], batch["chunk"], strict=True) if p >= following)
        parts = [rest]
        while following in waiting:
            parts.append(waiting.pop(following))
            following += 1
        *ended, rest = "".join(parts).split("\n")
        if any(t.rstrip("\r") == END for t in ended):
            state.remove()
        else:
            state.update((following, line + len(ended), rest, json.dumps(waiting)))
        if ended:
            yield pd.DataFrame({"connection": key[0], "line": range(line, line + len(ended)), "text": [t.removesuffix("\r") for t in ended]})

    return chunks.groupBy("connection").applyInPandasWithState(feed, "connection string, line long, text string", "following long, line long, rest string, early string", "append", GroupStateTimeout.NoTimeout)


def payloads(lines: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """lines with m (the "data:" line's payload) and broken (it is no JSON of the schema, and m is null); end marks and other lines are dropped."""
    data = lines.filter(F.col(text).startswith("data:")).withColumn("_data", F.trim(F.substring(text, 6, 1 << 30))).filter(F.col(text) != END)
    read = data.withColumn("m", F.from_json("_data", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    broken = F.col("m").isNull() | F.col("m._broken").isNotNull() | ~F.coalesce(F.trim("_data").startswith("{"), F.lit(False))
    return read.withColumn("broken", broken).withColumn("m", F.when(~F.col("broken"), F.col("m").dropFields("_broken"))).drop("_data")


def admitted(rows: DataFrame, key: str, time: str, span: str = "7 days", known: DataFrame | None = None) -> DataFrame:
    """key, admitted_at: each row's time that is the first of its key, or at least the span after the one admitted before it (known: key, admitted_at of earlier ones).

    Of each key the least time that may be admitted is found for all keys at once, then the next one: as many rounds as spans lie within the times, each a
    group-by that combines before it shuffles, over the rows that are left. No key's rows are gathered. A null time is never admitted; null keys are one key.
    """
    spark = rows.sparkSession
    left = rows.select(F.col(key).alias("key"), F.col(time).alias("at")).filter("at is not null")
    last, out = None if known is None else known.select(F.col(key).alias("key"), F.col("admitted_at").alias("last")), []
    while True:
        if last is not None:
            met = left.join(last.withColumnRenamed("key", "_k"), F.col("key").eqNullSafe(F.col("_k")), "left")
            left = _kept(met.filter(F.col("last").isNull() | (F.col("at") >= F.col("last") + F.expr(f"INTERVAL {span}"))).select("key", "at"))
        new = _kept(left.groupBy("key").agg(F.min("at").alias("at")))
        if new.isEmpty():
            break
        out.append(new)
        last = new.select("key", F.col("at").alias("last"))
        left = left.join(new.select(F.col("key").alias("_k")), F.col("key").eqNullSafe(F.col("_k")), "left_semi")
    found = out[0] if out else spark.createDataFrame([], left.schema)
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select(F.col("key").alias(key), F.col("at").alias("admitted_at"))


def _kept(rows: DataFrame) -> DataFrame:
    """rows as a table in the shared folder: a round's result doesn't hang on the rounds before it."""
    path = f"{scratch(rows.sparkSession)}/kept"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def admit_into(table: KeyedTable, out: str, time: str, span: str, stream: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows of keys that table (key, admitted_at) doesn't have, or has from the span ago, are written to out and noted in table.

    Batches come in order of time. A batch that is run again gives the same: what it admitted is written before it is noted, and noted batches are skipped.
    """

    def each(batch: DataFrame, number: int) -> None:
        version = table.version()
        if version.applied.get(stream, -1) >= number:
            return
        known = table.read(version.number) if version.schema else None
        new = admitted(batch, table.on, time, span, known)
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")
        table.merge(new, stream, number)

    return each


def expire(table: KeyedTable, now: Column, span: str = "7 days") -> int:
    """Deletes the keys that were admitted the span before now; the version without them."""
    return table.merge(table.read().filter(F.col("admitted_at") <= now - F.expr(f"INTERVAL {span}")).withColumn("admitted_at", now), gone=F.lit(True))


def harvest(groups: DataFrame, fetch: Callable[[int, DataFrame], DataFrame], most: int = 40) -> tuple[DataFrame, DataFrame]:
    """(group, item, round) of what was found, and (group, rounds, found): each round fetches items (group, item) of the groups that are open still, and a group is
    closed after a round that brings it nothing new, or after most rounds. The items found are kept in tables; the driver asks only whether any group is open.
    """
    spark = groups.sparkSession
    (name,) = groups.columns
    open_, found, asked = _kept(groups.distinct()), None, None
    for number in range(1, most + 1):
        page = fetch(number, open_).select(name, "item").distinct()
        seen = None if found is None else found.select(F.col(name).alias("_g"), F.col("item").alias("_i"))
        new = page if seen is None else page.join(seen, F.col(name).eqNullSafe(F.col("_g")) & F.col("item").eqNullSafe(F.col("_i")), "left_anti")
        new = _kept(new.withColumn("round", F.lit(number)))
        rounds = open_.withColumn("rounds", F.lit(number))
        found, asked = new if found is None else found.unionByName(new), rounds if asked is None else asked.unionByName(rounds)
        open_ = _kept(new.select(name).distinct())
        if open_.isEmpty():
            break
    if found is None:
        found, asked = groups.limit(0).withColumns({"item": F.lit(""), "round": F.lit(0)}), groups.distinct().withColumn("rounds", F.lit(0))
    sizes = found.groupBy(name).agg(F.count(F.lit(1)).alias("found"))
    used = asked.groupBy(name).agg(F.max("rounds").alias("rounds"))
    met = used.join(sizes.withColumnRenamed(name, "_g"), F.col(name).eqNullSafe(F.col("_g")), "left")
    return found, met.select(name, "rounds", F.coalesce("found", F.lit(0)).alias("found"))
