"""The event job as Structured Streaming: rules, rates, correlation, budgets, sessions, anomalies.

All queries are event-time, with a watermark, and restart from their checkpoint. Late rows beyond the
watermark are dropped by Spark and counted in the query's progress.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from agentscan.operators.events import CHAIN, CHAIN_SECONDS, HISTORY, RULES
from agentscan.operators.text import text_payloads

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
LATE = "10 minutes"


def read_events(spark: SparkSession, path: str, files_at_once: int = 4, late: str = LATE) -> DataFrame:
    """Events as they arrive in a folder of Parquet files, with their watermark."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(path).withWatermark("ts", late)


def rule_matches(events: DataFrame, rules=RULES) -> DataFrame:
    """Stream-static join with the rules, a few rows that are broadcast; actions are labels."""
    r = events.sparkSession.createDataFrame(list(rules), "rule string, event_type string, least double, severity string, action string")
    return events.join(F.broadcast(r), "event_type").where("value >= least").select("event_id", "ts", "user_id", "rule", "severity", "action")


def rates(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 minute"), "event_type").count().select(F.col("window.start").alias("minute"), "event_type", F.col("count").alias("n"))


def correlation(events: DataFrame) -> DataFrame:
    """Sliding minutes with two types of a user's events or more; a set, as exact distinct counts can't stream."""
    w = events.groupBy(F.window("ts", "60 seconds", "10 seconds"), "user_id").agg(F.collect_set("event_type").alias("types"))
    return w.where(F.size("types") >= 2).select("user_id", F.col("window.start").alias("start"), F.array_join(F.array_sort("types"), "+").alias("correlation_key"))


def budget(events: DataFrame, most_value: float, most_calls: int) -> DataFrame:
    h = events.groupBy(F.window("ts", "1 hour")).agg(F.sum("value").alias("spent"), F.count("*").alias("calls"))
    return h.where((F.col("spent") > most_value) | (F.col("calls") > most_calls)).select(F.col("window.start").alias("hour"), "spent", "calls")


def sessions(events: DataFrame) -> DataFrame:
    return events.groupBy(F.session_window("ts", "30 minutes"), "user_id").count().select("user_id", F.col("session_window.start").alias("start"), F.col("count").alias("n"))


def once(events: DataFrame) -> DataFrame:
    """Events without replays: one row of each event_id within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def chains(events: DataFrame, first: str, then: str, within: str = "10 minutes") -> DataFrame:
    """A user's event of one type followed by one of another in time: a join of the stream with itself."""
    a = events.where(F.col("event_type") == first).select(F.col("user_id").alias("u"), F.col("ts").alias("began"), F.col("event_id").alias("first_id"))
    b = events.where(F.col("event_type") == then).select("user_id", "ts", "event_id")
    return a.join(b, (F.col("u") == F.col("user_id")) & (F.col("ts") > F.col("began")) & (F.col("ts") <= F.col("began") + F.expr(f"interval {within}")))


def bursts(events: DataFrame, most: int, within: str = "60 minutes") -> DataFrame:
    """A user's windows with ``most`` events of a type or more; the batch form is a query."""
    w = events.groupBy(F.window("ts", within), "user_id", "event_type").count()
    return w.where(F.col("count") >= most).select("user_id", "event_type", F.col("window.start").alias("start"), F.col("count").alias("n"))


def unknown(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """Events of actors that the allow-list (user_id) doesn't hold."""
    return events.join(allowed.select(F.col("user_id").alias("ok")), F.col("user_id") == F.col("ok"), "left").where("ok is null").drop("ok")


class _Deviations(StatefulProcessor):
    """Scores a type's finished minutes in turn. State is three sums a type."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "k long, s double, q double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        k, s, q = self.sums.get() or (0, 0.0, 0.0)
        for minute, n in sorted((r["minute"], r["n"]) for r in rows):
            sd = max(q / k - (s / k) ** 2, 0.0) ** 0.5 if k else 0.0
            yield Row(event_type=key[0], minute=minute, n=n, z=(n - s / k) / sd if k >= HISTORY and sd > 0 else 0.0)
            k, s, q = k + 1, s + n, q + n * n
        self.sums.update((k, s, q))

    def close(self) -> None:
        pass


def zscores(events: DataFrame) -> DataFrame:
    """Deviation of each finished minute's rate of a type from all its minutes before, in two stages.

    Minutes are counted by a windowed aggregation, combined before the shuffle, and leave it once when the
    watermark has passed their end: late rows are counted until then and dropped after it. Only finished
    minutes, one row each, reach the state of their type. It needs no clock, so a run over what is there ends.
    """
    keep_state_in_rocksdb(events.sparkSession)
    minutes = rates(events)
    return minutes.groupBy("event_type").transformWithState(_Deviations(), "event_type string, minute timestamp, n long, z double", "Append", "None")


class _Chains(StatefulProcessor):
    """An automaton for each actor: for every length of the chain's beginning, where the latest one such began.

    Events wait until the watermark has passed them and are then read in order; one timer stands at the
    earliest that waits. When nothing waits and no beginning is still in time, the actor's state goes.
    """

    def __init__(self, chain: tuple[str, ...], within: int) -> None:
        self.chain, self.within = chain, within * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, event_type string")
        self.begun = handle.getListState("begun", "length int, began long, first_id long")

    def _wait(self, at: int, timerValues) -> None:  # noqa: N803
        self.handle.registerTimer(max(at // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = [(r["at"], r["event_id"], r["event_type"]) for r in rows if r["at"] > passed]  # a row behind the watermark is too late
        if new:
            self.waiting.appendList(new)
            self._wait(min(new)[0], timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        begun = {r[0]: (r[1], r[2]) for r in self.begun.get()}
        out = []
        for at, event_id, kind in (w for w in waiting if w[0] <= passed):
            for k in reversed(range(len(self.chain))):  # longest first, so that an event takes one step alone
                if kind != self.chain[k] or k and k not in begun:
                    continue
                began = begun[k] if k else (at, event_id)
                if k + 1 < len(self.chain):
                    begun[k + 1] = began
                elif at - began[0] <= self.within:
                    out.append(Row(user_id=key[0], event_id=event_id, at=at, first_id=began[1], began=began[0]))
        left = [w for w in waiting if w[0] > passed]
        begun = {k: b for k, b in begun.items() if passed - b[0] <= self.within}
        self.waiting.put(left) if left else self.waiting.clear()
        self.begun.put([(k, *b) for k, b in begun.items()]) if begun else self.begun.clear()
        if left:
            self._wait(left[0][0], timerValues)
        elif begun:
            self._wait(max(b[0] for b in begun.values()) + self.within, timerValues)
        return iter(out)

    def close(self) -> None:
        pass


def attack_chains(events: DataFrame, chain: tuple[str, ...] = CHAIN, within: int = CHAIN_SECONDS) -> DataFrame:
    """The stream's form of the batch operator of this name: the same rows, each when the watermark has passed it."""
    keep_state_in_rocksdb(events.sparkSession)
    rows = events.where(F.col("event_type").isin(*chain) & F.col("user_id").isNotNull()).select("user_id", "ts", F.unix_micros("ts").alias("at"), "event_id", "event_type")
    found = rows.groupBy("user_id").transformWithState(_Chains(chain, within), "user_id long, event_id long, at long, first_id long, began long", "Append", "EventTime")
    return found.select("user_id", "event_id", F.timestamp_micros("at").alias("ts"), "first_id", F.timestamp_micros("began").alias("began"))


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State of several variables and timers needs the store that spills to disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def policy_failures(raw: DataFrame) -> DataFrame:
    """Unreadable payloads (event_id, ts, props) as findings of the deny class."""
    p = F.from_json("props", "k long, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return raw.withColumn("p", p).where("p is null or p._corrupt_record is not null").select("event_id", "ts", F.lit("policy_parse_failure").alias("check_id"), F.lit("critical").alias("severity"))


def message_payloads(messages: DataFrame) -> DataFrame:
    """Payload findings of a stream of messages (key, surface, content); the text scan has no state."""
    return text_payloads(messages)


def start(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes a stream to Parquet, all that is there now, and returns the query."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent(spark: SparkSession, path: str, event_type: str, since: str) -> DataFrame:
    """Recent events of a type from the sink of an earlier query."""
    return spark.read.parquet(path).where((F.col("event_type") == event_type) & (F.col("ts") >= F.lit(since).cast("timestamp")))
