"""Runtime events in batch: rules, rates, anomalies, correlation, bursts, budgets, sessions, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentscan.functions.rules import quoted
from agentscan.sources.derived import audit_log, payload_events, read

#: Fixed values: (rule, event type, least value, severity, action); actions are labels, nothing is stopped.
RULES = (("R1", "error", 0.0, "medium", "log"), ("R2", "error", 90.0, "high", "alert"), ("R3", "purchase", 95.0, "critical", "pause"), ("R4", "signup", 99.0, "critical", "kill"), ("R5", "click", 50.0, "low", "log"))
#: Minutes of history before a deviation is scored.
HISTORY = 30
BURST, BURST_MINUTES = 2, 60
BUDGET_VALUE, BUDGET_CALLS = 600.0, 12
SESSION = "30 minutes"
#: Event types in the order of an attack chain, and the time from its first to its last.
CHAIN = ("view", "click", "purchase")
CHAIN_SECONDS = 86_400


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


def matches(e: DataFrame, rules=RULES) -> DataFrame:
    """Every rule that an event meets; rules are a few rows, broadcast."""
    r = e.sparkSession.createDataFrame(list(rules), "rule string, event_type string, least double, severity string, action string")
    return e.join(F.broadcast(r), "event_type").where(F.col("value") >= F.col("least")).select("event_id", "ts", "user_id", "event_type", "rule", "severity", "action")


def q_matches(spark, sf_dir):
    return matches(events(spark, sf_dir)).groupBy("rule", "action", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


_RULES_SQL = ", ".join(f"({quoted(a)}, {quoted(b)}, {c}, {quoted(d)}, {quoted(x)})" for a, b, c, d, x in RULES)
SQL_MATCHES = f"""WITH r(rule, event_type, least, severity, action) AS (VALUES {_RULES_SQL}) SELECT rule, action, ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events JOIN r USING (event_type) WHERE value >= least GROUP BY ALL"""


def q_rates(spark, sf_dir):
    """Events of each type in each minute."""
    return events(spark, sf_dir).groupBy(F.window("ts", "1 minute").start.alias("minute"), "event_type").agg(F.count("*").alias("n"))


SQL_RATES = "SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n FROM events GROUP BY ALL"


def zscores(e: DataFrame) -> DataFrame:
    """Each minute's rate of a type against all its earlier minutes that have events; 0 until HISTORY of them exist.

    Sums of whole days are carried forward first, so that no window holds more than a day of one type
    and the days of one type.
    """
    n = e.groupBy("event_type", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").cast("double").alias("n")).withColumn("day", F.to_date("minute"))
    days = n.groupBy("event_type", "day").agg(F.count("*").alias("k"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    before = Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("event_type", "day", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "ksq"])
    inside = Window.partitionBy("event_type", "day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    own = n.select("event_type", "minute", "day", "n", *[F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"{c}1") for c, x in (("k", F.lit(1)), ("s", F.col("n")), ("q", F.col("n") * F.col("n")))])
    j = own.join(carried, ["event_type", "day"])
    k, s, q = (F.col(f"{c}0") + F.col(f"{c}1") for c in "ksq")
    mean = F.try_divide(s, k)
    sd = F.sqrt(F.greatest(F.try_divide(q, k) - mean * mean, F.lit(0.0)))
    z = F.when((k >= HISTORY) & (sd > 0), F.try_divide(F.col("n") - mean, sd)).otherwise(0.0)
    return j.select("event_type", "minute", F.col("n").cast("long").alias("n"), F.round(z, 6).alias("z"))


def q_zscores(spark, sf_dir):
    return zscores(events(spark, sf_dir))


SQL_ZSCORES = f"""WITH n AS (SELECT event_type, date_trunc('minute', ts) AS minute, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
w AS (SELECT *, count(*) OVER b AS k, avg(n) OVER b AS m, stddev_pop(n) OVER b AS sd FROM n WINDOW b AS (PARTITION BY event_type ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_type, minute, n::BIGINT AS n, round(CASE WHEN k >= {HISTORY} AND sd > 0 THEN (n - m) / sd ELSE 0 END, 6) AS z FROM w"""


def q_correlation(spark, sf_dir):
    """Sliding minutes, every 10 seconds, in which a user shows two types of events or more."""
    w = events(spark, sf_dir).groupBy("user_id", F.window("ts", "60 seconds", "10 seconds").start.alias("start")).agg(F.sort_array(F.collect_set("event_type")).alias("types"), F.count("*").alias("n"))
    return w.where(F.size("types") >= 2).select("user_id", "start", F.array_join("types", "+").alias("correlation_key"), "n")


SQL_CORRELATION = """WITH w AS (SELECT user_id, event_type, time_bucket(INTERVAL '10 seconds', ts, TIMESTAMP '1970-01-01') - INTERVAL (k * 10) SECOND AS start FROM events, range(6) t(k))
SELECT user_id, start, array_to_string(list_sort(list(DISTINCT event_type)), '+') AS correlation_key, count(*) AS n FROM w GROUP BY user_id, start HAVING count(DISTINCT event_type) >= 2"""


def q_bursts(spark, sf_dir):
    """Users with more events of a type in a window than a burst allows."""
    return events(spark, sf_dir).groupBy("user_id", "event_type", F.window("ts", f"{BURST_MINUTES} minutes").start.alias("start")).agg(F.count("*").alias("n")).where(F.col("n") >= BURST)


SQL_BURSTS = f"SELECT user_id, event_type, time_bucket(INTERVAL '{BURST_MINUTES} minutes', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= {BURST}"


def q_budget(spark, sf_dir):
    """Hours in which spending or calls exceed their caps."""
    h = events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.sum("value"), 2).alias("spent"), F.count("*").alias("calls"))
    return h.where((F.col("spent") > BUDGET_VALUE) | (F.col("calls") > BUDGET_CALLS)).select("hour", "spent", "calls", (F.col("spent") > BUDGET_VALUE).alias("over_value"), (F.col("calls") > BUDGET_CALLS).alias("over_calls"))


SQL_BUDGET = f"SELECT date_trunc('hour', ts) AS hour, round(sum(value), 2) AS spent, count(*) AS calls, round(sum(value), 2) > {BUDGET_VALUE} AS over_value, count(*) > {BUDGET_CALLS} AS over_calls FROM events GROUP BY 1 HAVING round(sum(value), 2) > {BUDGET_VALUE} OR count(*) > {BUDGET_CALLS}"


def q_sessions(spark, sf_dir):
    """Users' sessions, which end after half an hour without events."""
    s = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", SESSION).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return s.select("user_id", F.col("w.start").alias("start"), "last", "n")


SQL_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k"""


def attack_chains(e: DataFrame, chain: tuple[str, ...] = CHAIN, within: int = CHAIN_SECONDS) -> DataFrame:
    """(user_id, event_id, ts, first_id, began): events that end a chain of types, others between them allowed, in time.

    Of the chains that end with an event the one that began last counts, which is in time if any is. A
    user's events are dealt by spans of the time limit, each with the span before it, so that no window
    holds more than two spans of a user. Events of one time follow their ids; nulls take no part.
    """
    second = F.unix_micros(F.col("ts").cast("timestamp"))
    span = F.floor(second / (within * 1_000_000))
    near = e.where("user_id is not null and ts is not null").select("user_id", "event_id", "ts", "event_type", F.explode(F.array(F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own")))).alias("in"))
    near = near.select("user_id", "event_id", "ts", "event_type", "in.*")
    before = Window.partitionBy("user_id", "span").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.struct(F.col("ts").alias("began"), F.col("event_id").alias("first_id"))
    for k, kind in enumerate(chain):
        if k:
            reached = F.col(f"until{k}")
        here = F.when(F.col("event_type") == kind, reached)
        if k + 1 < len(chain):
            near = near.withColumn(f"until{k + 1}", F.last(here, ignorenulls=True).over(before))
    done = near.where((F.col("event_type") == chain[-1]) & F.col("own")).select("user_id", "event_id", "ts", reached.alias("begin"))
    return done.select("user_id", "event_id", "ts", "begin.first_id", "begin.began").where(second - F.unix_micros(F.col("began").cast("timestamp")) <= within * 1_000_000)


def q_chain(spark, sf_dir):
    """Events that end an attack chain, with the event that began it."""
    return attack_chains(events(spark, sf_dir))


SQL_CHAIN = f"""WITH a AS (SELECT *, last_value(CASE WHEN event_type = '{CHAIN[0]}' THEN {{'began': ts, 'first_id': event_id}} END IGNORE NULLS) OVER w AS u1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, last_value(CASE WHEN event_type = '{CHAIN[1]}' THEN u1 END IGNORE NULLS) OVER w AS u2 FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id, ts, u2.first_id AS first_id, u2.began AS began FROM b WHERE event_type = '{CHAIN[2]}' AND ts - u2.began <= to_seconds({CHAIN_SECONDS})"""


def q_unknown_actors(spark, sf_dir):
    """Actors of a day that the day's allow-list doesn't know, and those that were there the day before."""
    e = events(spark, sf_dir).select("user_id", F.to_date("ts").alias("day")).distinct()
    allowed = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).where("user_id % 3 = 0")
    new = e.join(allowed, "user_id", "left_anti")
    before = e.select("user_id", F.date_add("day", 1).alias("day"), F.lit(True).alias("seen"))
    return new.join(before, ["user_id", "day"], "left").groupBy("day").agg(F.count("*").alias("unknown"), F.count_if(F.col("seen").isNull()).alias("new"))


SQL_UNKNOWN = """WITH e AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), n AS (SELECT * FROM e WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0))
SELECT n.day, count(*) AS unknown, count(*) FILTER (b.user_id IS NULL) AS new FROM n LEFT JOIN e b ON b.user_id = n.user_id AND b.day + 1 = n.day GROUP BY n.day"""


def policy_rows(e: DataFrame) -> DataFrame:
    """Events whose payload can't be read become findings of the deny class, not dropped rows."""
    parsed = F.from_json("props", "k long, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    p = e.select("event_id", "event_type", parsed.alias("p"))
    return p.select("event_id", "event_type", F.col("p.k").alias("k"), F.when(F.col("p._corrupt_record").isNotNull(), "policy_parse_failure").otherwise("ok").alias("verdict"))


def q_policy(spark, sf_dir):
    return policy_rows(payload_events(spark, sf_dir)).groupBy("event_type", "verdict").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


SQL_POLICY = "SELECT event_type, CASE WHEN event_id % 97 = 0 THEN 'policy_parse_failure' ELSE 'ok' END AS verdict, count(*) AS n, sum(CASE WHEN event_id % 97 <> 0 THEN json_extract(props, '$.k')::BIGINT END)::BIGINT AS k FROM events GROUP BY ALL"


def q_suite_metrics(spark, sf_dir):
    """Errors as attacks, values over 50 as alarms: detection and false-alarm rates, mean and p95 time."""
    e = events(spark, sf_dir).select((F.col("event_type") == "error").alias("attack"), (F.col("value") > 50).alias("alarm"), F.col("value"), F.to_date("ts").alias("day"))
    m = e.groupBy("day").agg(
        F.count_if("attack").alias("attacks"),
        F.count_if(F.col("attack") & F.col("alarm")).alias("detected"),
        F.count_if(~F.col("attack")).alias("benign"),
        F.count_if(~F.col("attack") & F.col("alarm")).alias("false_alarms"),
        F.round(F.avg(F.when(F.col("attack") & F.col("alarm"), F.col("value"))), 6).alias("mean_time"),
        F.expr("percentile_disc(0.95) within group (order by case when attack and alarm then value end)").alias("p95_time"),
    )
    return m.select("*", F.round(F.try_divide("detected", "attacks"), 6).alias("detection_rate"), F.round(F.try_divide("false_alarms", "benign"), 6).alias("false_positive_rate"))


SQL_SUITE = """WITH e AS (SELECT event_type = 'error' AS attack, value > 50 AS alarm, value, ts::DATE AS day FROM events)
SELECT day, count(*) FILTER (attack) AS attacks, count(*) FILTER (attack AND alarm) AS detected, count(*) FILTER (NOT attack) AS benign, count(*) FILTER (NOT attack AND alarm) AS false_alarms,
round(avg(value) FILTER (attack AND alarm), 6) AS mean_time, quantile_disc(value, 0.95) FILTER (attack AND alarm) AS p95_time,
round(count(*) FILTER (attack AND alarm) / nullif(count(*) FILTER (attack), 0), 6) AS detection_rate, round(count(*) FILTER (NOT attack AND alarm) / nullif(count(*) FILTER (NOT attack), 0), 6) AS false_positive_rate FROM e GROUP BY day"""


def chain_breaks(log: DataFrame) -> DataFrame:
    """Rows (seq, raw, prev_hash) that don't continue the row before, or that have none.

    Each row meets its predecessor by number, an even join, where a lag over the whole log would put
    it into one task.
    """
    before = log.select((F.col("seq") + 1).alias("seq"), F.sha2("raw", 256).alias("want"))
    j = log.join(before, "seq", "left")
    genesis = F.col("prev_hash") == F.repeat(F.lit("0"), 64)
    kind = F.when(F.col("want").isNull() & ~genesis, "gap").when(F.col("want") != F.col("prev_hash"), "hash")
    return j.select("seq", kind.alias("kind")).where("kind is not null")


def q_hash_chain(spark, sf_dir):
    """All breaks, and the first of them once more as such."""
    breaks = chain_breaks(audit_log(spark, sf_dir))
    first = breaks.agg(F.min("seq").alias("seq")).where("seq is not null").select("seq", F.lit("first").alias("kind"))
    return breaks.unionByName(first)


SQL_HASH = """WITH l AS (SELECT event_id AS seq, concat_ws('|', event_id, user_id, event_type, round(value * 100)::BIGINT) AS raw0 FROM events),
p AS (SELECT seq, CASE WHEN seq % 1000 = 7 THEN raw0 || '!' ELSE raw0 END AS raw, coalesce(sha256(lag(raw0) OVER (ORDER BY seq)), repeat('0', 64)) AS prev_hash FROM l),
w AS (SELECT seq, prev_hash, sha256(lag(raw) OVER (ORDER BY seq)) AS want FROM p), b AS (SELECT seq FROM w WHERE want <> prev_hash) SELECT seq, 'hash' AS kind FROM b UNION ALL SELECT min(seq), 'first' FROM b"""

QUERIES = {
    "event_rule_matches": (q_matches, SQL_MATCHES),
    "event_minute_rates": (q_rates, SQL_RATES),
    "event_zscores": (q_zscores, SQL_ZSCORES),
    "event_correlation": (q_correlation, SQL_CORRELATION),
    "event_bursts": (q_bursts, SQL_BURSTS),
    "event_hourly_budget": (q_budget, SQL_BUDGET),
    "event_sessions": (q_sessions, SQL_SESSIONS),
    "event_attack_chain": (q_chain, SQL_CHAIN),
    "event_unknown_actors": (q_unknown_actors, SQL_UNKNOWN),
    "event_policy_failures": (q_policy, SQL_POLICY),
    "suite_metrics": (q_suite_metrics, SQL_SUITE),
    "hash_chain_audit": (q_hash_chain, SQL_HASH),
}
