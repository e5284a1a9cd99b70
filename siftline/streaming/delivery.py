"""Delivery from a stream with leases: claims by batch, a ledger of what was sent, holds per channel.

Everything lives in one ledger folder that all executors see:

    queue/batch=N     the rows that came with batch N (overwritten when the batch runs again)
    claims/batch=N    the rows that batch N took, with the end of its lease (the same)
    marks/            one small file per send, before it (sending) and after it (what became of it)

A batch that was killed runs again under its number: rows with an outcome are left alone, rows it had not begun are sent,
and a row of which only the beginning is known waits until the lease is over, because it may have gone out. Then it is sent again
under the same key (id and attempt), by which a transport can tell: a rare repetition beats a lost alert. Rows that another batch
holds a live lease on are not touched. The files of a channel are few: people read what they announce.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.operators.delivery import EXPIRE_S, FINAL, after
from siftline.sources.feed_source import folder

LEASE_S = 600
ROW = "id long, channel string, kind string, priority int, created_at long, body string"
MARK = "id long, channel string, attempts int, at long, status string, outcome string, due long, hold long, error string"


def marks(spark: SparkSession, ledger: str) -> DataFrame:
    """Every mark of the ledger; none where nothing was sent yet."""
    fs, base = folder(ledger)
    fs.create_dir(f"{base}/marks", recursive=True)
    return spark.read.schema(MARK).json(f"{ledger}/marks")


def latest(found: DataFrame) -> DataFrame:
    """The last mark of every row; at one time, an outcome goes before its beginning."""
    order = W.partitionBy("id").orderBy(F.desc("attempts"), F.asc(F.col("status") == "SENDING"), F.desc("at"))
    return found.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")


def saved_tables(spark: SparkSession, ledger: str, name: str, schema: str) -> DataFrame:
    fs, base = folder(ledger)
    fs.create_dir(f"{base}/{name}", recursive=True)
    return spark.read.schema(f"{schema}, batch long").parquet(f"{ledger}/{name}")


def due_rows(spark: SparkSession, ledger: str, batch: int, now: int) -> DataFrame:
    """Rows that batch may send now, with their attempts so far."""
    queue = saved_tables(spark, ledger, "queue", ROW).drop("batch").dropDuplicates(["id"])
    seen = marks(spark, ledger)
    last = latest(seen).select("id", F.col("status").alias("was"), "attempts", "due", F.col("at").alias("marked_at"))
    held = seen.groupBy("channel").agg(F.max("hold").alias("hold"))
    others = saved_tables(spark, ledger, "claims", "id long, until long").filter((F.col("batch") != batch) & (F.col("until") > now))
    free = queue.join(last, "id", "left").join(held, "channel", "left")
    status = F.coalesce("was", F.lit("PENDING"))
    begun = status == "SENDING"
    ready = ~status.isin(*FINAL) & (F.coalesce("due", F.lit(0)) <= now) & (F.coalesce("hold", F.lit(0)) <= now) & (~begun | (F.col("marked_at") + LEASE_S <= now))
    taken = others.join(seen.filter("status <> 'SENDING'").select("id", F.col("at").alias("done_at")), "id", "left").filter("done_at is null")
    return free.filter(ready).join(taken.select("id").distinct(), "id", "left_anti").withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def send_rows(rows: DataFrame, ledger: str, transport: Callable[[dict], tuple[str, str | None]], clock: Callable[[], int]) -> int:
    """Sends a channel's rows in order from one task, a mark before and after each; how many were sent. transport gives (outcome, error)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = folder(ledger)
        stopped: set[str] = set()
        for p in parts:
            n = 0
            for row in p.to_dict("records"):
                now, key = clock(), f"{row['id']}-{row['attempts']}"
                mark = lambda name, **more: put(fs, f"{base}/marks/{key}.{name}.json", {"id": row["id"], "channel": row["channel"], "at": now, **more})  # noqa: B023, E731
                if row["channel"] in stopped or known(fs, f"{base}/marks/{key}", now):
                    continue
                if now - row["created_at"] > EXPIRE_S:
                    mark("done", status="EXPIRED", attempts=row["attempts"], due=0, hold=0)
                    continue
                mark("sending", status="SENDING", attempts=row["attempts"], due=0, hold=0)
                outcome, error = transport({**row, "key": key})
                then = after(outcome, row["attempts"], now)
                # A send that doesn't count has the attempt's number again: its marks make way.
                mark("done" if then.status in FINAL else f"again-{now}", status=then.status, attempts=then.attempts, outcome=outcome, due=then.due, hold=then.hold, error=error)
                if then.status not in FINAL:
                    fs.delete_file(f"{base}/marks/{key}.sending.json")
                n += then.status == "SENT"
                if then.stops:
                    stopped.add(row["channel"])
            yield pd.DataFrame({"sent": [n]})

    kind = F.when(F.col("kind") == "URGENT", 0).when(F.col("kind") == "EDIT", 1).otherwise(2)
    ordered = rows.withColumn("rank", kind).repartition("channel").sortWithinPartitions("channel", "priority", "rank", "id").drop("rank", "was", "due", "hold", "marked_at")
    return ordered.mapInPandas(run, "sent long").agg(F.sum("sent")).first()[0] or 0


def put(fs: pafs.FileSystem, path: str, content: dict) -> None:
    with fs.open_output_stream(path) as out:
        out.write(json.dumps(content).encode())


def known(fs: pafs.FileSystem, key: str, now: int) -> bool:
    """Whether this attempt was finished, or begun within the lease (by another run of the same task)."""
    done, begun = fs.get_file_info([f"{key}.done.json", f"{key}.sending.json"])
    if done.type != pafs.FileType.NotFound:
        return True
    if begun.type == pafs.FileType.NotFound:
        return False
    with fs.open_input_stream(f"{key}.sending.json") as stream:
        return now < json.loads(stream.read())["at"] + LEASE_S


def deliver_batch(batch: DataFrame, number: int, ledger: str, transport: Callable[[dict], tuple[str, str | None]], clock: Callable[[], int] = lambda: int(time.time()), lease_s: int = LEASE_S) -> int:
    """One batch of queue rows (see ROW): joins the queue, claims what is due, sends it. Running it again sends nothing twice."""
    spark = batch.sparkSession
    batch.select(*(part.split()[0] for part in ROW.split(", "))).write.mode("overwrite").parquet(f"{ledger}/queue/batch={number}")
    now = clock()
    due = due_rows(spark, ledger, number, now)
    due.select("id", F.lit(now + lease_s).cast("long").alias("until")).write.mode("overwrite").parquet(f"{ledger}/claims/batch={number}")
    mine = spark.read.schema("id long, until long").parquet(f"{ledger}/claims/batch={number}")
    return send_rows(due_rows(spark, ledger, number, now).join(mine.select("id"), "id", "left_semi"), ledger, transport, clock)


def deliver_stream(alerts: DataFrame, ledger: str, transport: Callable[[dict], tuple[str, str | None]], checkpoint: str, every: str = "45 seconds", clock: Callable[[], int] = lambda: int(time.time())):
    """Starts delivery of a stream of queue rows; every trigger also takes up what is due again."""
    run = lambda batch, number: deliver_batch(batch, number, ledger, transport, clock) and None
    return alerts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
