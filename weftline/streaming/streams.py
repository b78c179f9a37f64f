"""Streams of events and pages: journals, exact and greedy duplicates, quiet gaps, fan-out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.catalog import RECORD

EVENT = "scan_id string, seq long, ts timestamp, type string, payload map<string,string>"


def journal_stream(spark: SparkSession, path: str) -> DataFrame:
    """Records appended to a folder of journals, as they come."""
    return spark.readStream.schema(RECORD).json(path).filter(F.col("page.url").isNotNull())


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events (``EVENT``) appended to a folder, each once and in the order of their files."""
    return spark.readStream.schema(EVENT).json(path).filter(F.col("type").isNotNull())


def journal_sink(records: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends records to a journal. After a crash or a stop the same checkpoint goes on where it
    ended, and nothing is written twice."""
    return records.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def stopped(query, finish: bool = True) -> None:
    """Ends a query; what has arrived by now is still worked on, unless ``finish`` is false."""
    if finish and query.isActive:
        query.processAllAvailable()
    query.stop()


PACED = "host string, i long, start_ms long"


def pacing_stream(arrivals: DataFrame) -> DataFrame:
    """When each request (host, i, arrival_ms, delay_ms) may start: a host's requests keep their distance over all
    batches; the state of a host is when it is free again."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (free,) = state.get if state.exists else (None,)
        rows = pd.concat(list(batches)).sort_values("i")
        starts = []
        for arrival, delay in zip(rows["arrival_ms"], rows["delay_ms"], strict=True):
            starts.append(int(arrival) if free is None else max(int(arrival), free))
            free = starts[-1] + int(delay)
        state.update((free,))
        yield pd.DataFrame({"host": key[0], "i": rows["i"], "start_ms": starts})

    return arrivals.groupBy("host").applyInPandasWithState(run, PACED, "free long", "append", GroupStateTimeout.NoTimeout)


def stamped(events: DataFrame, scan: str) -> DataFrame:
    """Events with the scan they belong to where they name none."""
    return events.withColumn("scan_id", F.coalesce("scan_id", F.lit(scan)))


def warnings(events: DataFrame) -> DataFrame:
    p = F.col("payload")
    return events.filter(F.col("type") == "warn").select("scan_id", p["url"].alias("url"), p["reason"].alias("reason"), p["message"].alias("message"))


def exact_stream(pages: DataFrame, delay: str | None = None) -> DataFrame:
    """The first page of each (scan_id, hash). With a delay, state of pages older than it is dropped."""
    if delay:
        return pages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["scan_id", "hash"])
    return pages.dropDuplicates(["scan_id", "hash"])


FATE = "scan_id string, sibling_key string, seq long, url string, fate string"
_KIN = "hashes array<string>, keys array<string>, urls array<string>, fingerprints array<bigint>"


def _distance(a: int, b: int) -> int:
    return ((int(a) ^ int(b)) & 0xFFFFFFFFFFFFFFFF).bit_count()


def greedy_stream(pages: DataFrame, mirror: int = 8, near: int = 0, quiet: str | None = None) -> DataFrame:
    """Fates (keep, exact, mirror, near) of pages (scan_id, sibling_key, seq, url, hash, fingerprint), decided in order of
    arrival. Kin of one path keep a state of their own; with ``near`` over 0 all pages of a scan are compared, so they
    share one. A state holds 40 hex digits for each content and a few values for each kept page. After ``quiet``, a time
    without pages of its group, a state is dropped."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hashes, keys, urls, prints = (list(x) for x in (state.get if state.exists else ([], [], [], [])))
        seen = set(hashes)
        rows = pd.concat(list(batches)).sort_values("seq")
        fates = []
        for own, url, digest, fp in zip(rows["sibling_key"], rows["url"], rows["hash"], rows["fingerprint"], strict=True):
            if digest in seen:
                fates.append("exact")
                continue
            seen.add(digest)
            hashes.append(digest)
            kept = zip(keys, urls, prints, strict=True)
            if own and any(k == own and u != url and _distance(f, fp) <= mirror for k, u, f in kept):
                fates.append("mirror")
            elif near > 0 and any(_distance(f, fp) <= near for f in prints):
                fates.append("near")
            else:
                keys.append(own)
                urls.append(url)
                prints.append(int(fp))
                fates.append("keep")
        state.update((hashes, keys, urls, prints))
        if quiet:
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame({"scan_id": key[0], "sibling_key": rows["sibling_key"], "seq": rows["seq"], "url": rows["url"], "fate": fates})

    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000) if quiet else 0
    by = ["scan_id"] if near > 0 else ["scan_id", "sibling_key"]
    timeout = GroupStateTimeout.ProcessingTimeTimeout if quiet else GroupStateTimeout.NoTimeout
    return pages.groupBy(*by).applyInPandasWithState(run, FATE, _KIN, "append", timeout)


def quiet_gaps(events: DataFrame, gap: str = "650 milliseconds", late: str = "5 seconds") -> DataFrame:
    """Bursts of responses of a scan, each ended by a gap."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("scan_id", w).agg(F.count("*").alias("n")).select("scan_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def type_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: events by type in tumbling windows, late ones up to a delay."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window), "type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "type", "n")


def fan_out(events: DataFrame, sinks: list, checkpoint: str):
    """Starts a query that hands every micro-batch to each sink (df, epoch)."""

    def each(df: DataFrame, epoch: int) -> None:
        df.persist()
        for sink in sinks:
            sink(df, epoch)
        df.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def recent(events: DataFrame, most: int = 20_000) -> DataFrame:
    """The newest events, for late subscribers."""
    return events.orderBy(F.desc("seq")).limit(most)
