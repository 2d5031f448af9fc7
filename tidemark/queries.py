"""The engine's queries over the driver's tables, each with the SQL of its oracle.

Disorder is made the same way in both engines: events arrive in the order of (event_id + event_id * 31 % 97, event_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog import query, table
from tidemark.functions import keys as K
from tidemark.functions.time import Session, Sliding, Tumbling, epoch_micros, epoch_millis, event_millis, seconds_to_millis
from tidemark.operators import cluster, delivery, metrics, sinks, state
from tidemark.operators import validation as V
from tidemark.operators.aggregate import ordered_fold, window_aggregate
from tidemark.operators.eventtime import active_sessions, assign_windows, sessions, split_late, with_watermark
from tidemark.operators.joins import windowed_join
from tidemark.plans.pipeline import Pipeline, Router
from tidemark.plans.prefix import dense_numbers
from tidemark.sources import commit_log
from tidemark.storage import new_path

HOUR = 3_600_000
ARRIVAL = ["arr", "event_id"]
_E = "SELECT *, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us, event_id + (event_id * 31) % 97 AS arr, round(value * 100)::BIGINT AS cents FROM events"
_SLIDING = "(SELECT *, ms // {slide} * {slide} - {slide} * unnest(range(({size} - 1) // {slide} + 1)) AS start_ms FROM e)"


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.withColumns({"ms": epoch_millis(F.col("ts")), "us": epoch_micros(F.col("ts")), "arr": F.col("event_id") + (F.col("event_id") * 31) % 97, "cents": F.round(F.col("value") * 100).cast("long")})


def cents():
    return F.sum("cents").alias("cents")


# Envelopes, pipelines, routing, validation


@query("emit_envelope", f"SELECT event_id::VARCHAR AS event_id, coalesce(CASE WHEN event_id % 10 > 0 THEN event_type END, 'GenericEvent') AS event_type, ms AS timestamp_ms, props AS payload FROM ({_E})")
def emit_envelope(spark, d):
    e = events(spark, d)
    made = V.envelope(e, F.col("event_id"), F.col("ms"), F.col("props"), F.when(F.col("event_id") % 10 > 0, F.col("event_type")))
    return made.select("event_id", "event_type", F.col("timestamp").alias("timestamp_ms"), "payload")


@query("dsl_map_filter_sink", f"SELECT event_id, cents * 2 AS doubled FROM ({_E}) WHERE cents * 2 > 10000")
def dsl_map_filter_sink(spark, d):
    return Pipeline().map(doubled=F.col("cents") * 2).filter(F.col("doubled") > 10000).select("event_id", "doubled").build(events(spark, d))


@query("dsl_map_null_drops", f"SELECT event_id, cents AS kept FROM ({_E}) WHERE event_type <> 'view'")
def dsl_map_null_drops(spark, d):
    return Pipeline().map(kept=F.when(F.col("event_type") != "view", F.col("cents"))).select("event_id", "kept").build(events(spark, d))


@query("dsl_filter_truthy", f"SELECT event_id FROM ({_E}) WHERE event_id % 3 <> 0")
def dsl_filter_truthy(spark, d):
    return Pipeline().filter(F.col("event_id") % 3).select("event_id").build(events(spark, d))


def _orders_router(default: str | None) -> Router:
    router = Router().add_route(F.col("o_totalprice") > 200000, "high").add_route(F.col("o_totalprice") > 100000, "standard")
    return router.default_route(default) if default else router


@query("router_first_match", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'standard' END AS topic FROM orders WHERE o_totalprice > 100000")
def router_first_match(spark, d):
    return _orders_router(None).route(table(spark, d, "orders")).select("o_orderkey", "topic")


@query("router_default", "SELECT CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'standard' ELSE 'low' END AS topic, count(*) AS n FROM orders GROUP BY 1")
def router_default(spark, d):
    return _orders_router("low").route(table(spark, d, "orders")).groupBy("topic").agg(F.count("*").alias("n"))


@query("router_drop", "SELECT count(*) AS kept FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority IS NULL")
def router_drop(spark, d):
    router = Router().add_route(F.col("o_orderstatus") == "F", "done").add_route(F.col("o_orderpriority").isNull(), "odd")
    return router.route(table(spark, d, "orders")).agg(F.count("*").alias("kept"))


def _checks():
    return {"quantity": F.col("l_quantity") > 2, "discount": F.col("l_discount") <= 0.08, "flag": F.col("l_returnflag").isin("A", "N", "R")}


_CHECK_SQL = "CASE WHEN NOT l_quantity > 2 THEN 'quantity' WHEN NOT l_discount <= 0.08 THEN 'discount' WHEN l_returnflag NOT IN ('A', 'N', 'R') THEN 'flag' END"


@query("validate_split", f"SELECT l_orderkey, l_linenumber, {_CHECK_SQL} AS _error FROM lineitem WHERE {_CHECK_SQL} IS NOT NULL")
def validate_split(spark, d):
    return V.validate_split(table(spark, d, "lineitem"), _checks())[1].select("l_orderkey", "l_linenumber", "_error")


@query("validate_valid", f"SELECT l_returnflag, count(*) AS n FROM lineitem WHERE {_CHECK_SQL} IS NULL GROUP BY 1")
def validate_valid(spark, d):
    return V.validate_split(table(spark, d, "lineitem"), _checks())[0].groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("registry_dispatch", "SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN event_type ELSE 'BaseEvent' END AS model, count(*) AS n FROM events GROUP BY 1")
def registry_dispatch(spark, d):
    registry = V.SchemaRegistry()
    for name in ("purchase", "signup"):
        registry.register(name, V.Schema(T.StructType([T.StructField("k", T.LongType())])))
    return table(spark, d, "events").groupBy(registry.model(F.col("event_type")).alias("model")).agg(F.count("*").alias("n"))


@query("event_time_of_record", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 WHEN event_id % 3 = 1 THEN event_id * 1000 + 500 ELSE 1700000000000 END AS ms FROM events")
def event_time_of_record(spark, d):
    """A record's own time, as a timestamp or as seconds; without one, the time that it arrived at."""
    e = table(spark, d, "events")
    stamp, seconds = F.when(F.col("event_id") % 3 == 0, F.col("ts")), F.when(F.col("event_id") % 3 == 1, seconds_to_millis(F.col("event_id") + 0.5))
    return e.select("event_id", event_millis(stamp, F.coalesce(seconds, F.lit(1_700_000_000_000))).alias("ms"))


@query("json_payload_decode", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_payload_decode(spark, d):
    schema = V.Schema(T.StructType([T.StructField("k", T.LongType())]))
    return V.decode(table(spark, d, "events"), "props", schema).select("event_id", F.col("body.k").alias("k"))


@query("schema_evolution", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS amount, 'USD' AS currency FROM events")
def schema_evolution(spark, d):
    fields = T.StructType([T.StructField("amount", T.LongType()), T.StructField("currency", T.StringType())])
    schema = V.Schema(fields, defaults={"currency": F.lit("USD")}, aliases={"amount": "k"})
    return V.decode(table(spark, d, "events"), "props", schema).select("event_id", "body.amount", "body.currency")


@query("fan_in", "SELECT topic, count(*) AS n FROM (SELECT 'orders' AS topic FROM orders UNION ALL SELECT 'events' FROM events) GROUP BY 1")
def fan_in(spark, d):
    both = table(spark, d, "orders").select(F.lit("orders").alias("topic")).unionByName(table(spark, d, "events").select(F.lit("events").alias("topic")))
    return both.groupBy("topic").agg(F.count("*").alias("n"))


_CRC_TABLE = "SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)"


@query(
    "partition_assign",
    f"""WITH c AS ({_CRC_TABLE}), e AS (SELECT event_id, list_transform(range(1, strlen(user_id::VARCHAR) + 1), lambda i: ord(substr(user_id::VARCHAR, i, 1))::BIGINT) AS bytes FROM events)
SELECT event_id, (xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295::BIGINT) % 4)::INT AS partition FROM e, c""",
)
def partition_assign(spark, d):
    return table(spark, d, "events").select("event_id", K.partition_of(F.col("user_id"), 4).alias("partition"))


@query("message_id_order", "SELECT event_id, row_number() OVER (ORDER BY event_id // 7, event_id % 7) - 1 AS place FROM events")
def message_id_order(spark, d):
    """Places of ids such as "12-3" in numeric order, over the whole table without one window."""
    ids = table(spark, d, "events").select("event_id", K.parse_message_id(F.concat_ws("-", F.floor(F.col("event_id") / 7).cast("long"), F.col("event_id") % 7)).alias("id"), F.lit(0).alias("one"))
    return dense_numbers(ids, ["one"], ["id"], "place").select("event_id", "place")


# Windows, sessions, watermarks


@query("assign_tumbling", f"SELECT event_id, ms // {HOUR} * {HOUR} AS start_ms, ms // {HOUR} * {HOUR} + {HOUR} AS end_ms FROM ({_E})")
def assign_tumbling(spark, d):
    return assign_windows(events(spark, d), F.col("ms"), Tumbling(HOUR)).select("event_id", "start_ms", "end_ms")


@query("assign_sliding", f"WITH e AS ({_E}) SELECT event_id, start_ms, start_ms + {6 * HOUR} AS end_ms FROM {_SLIDING.format(size=6 * HOUR, slide=2 * HOUR)} WHERE start_ms + {6 * HOUR} > ms")
def assign_sliding(spark, d):
    return assign_windows(events(spark, d), F.col("ms"), Sliding(6 * HOUR, 2 * HOUR)).select("event_id", "start_ms", "end_ms")


@query("assign_sliding_gap", f"WITH e AS ({_E}) SELECT event_id, ms // {5 * HOUR} * {5 * HOUR} AS start_ms FROM e WHERE ms // {5 * HOUR} * {5 * HOUR} + {2 * HOUR} > ms")
def assign_sliding_gap(spark, d):
    return assign_windows(events(spark, d), F.col("ms"), Sliding(2 * HOUR, 5 * HOUR)).select("event_id", "start_ms")


@query("assign_session", f"SELECT event_id, ms AS start_ms, ms + {HOUR} AS end_ms FROM ({_E})")
def assign_session(spark, d):
    return assign_windows(events(spark, d), F.col("ms"), Session(HOUR)).select("event_id", "start_ms", "end_ms")


@query("window_sliding_count", f"WITH e AS ({_E}) SELECT event_type, start_ms, start_ms + {6 * HOUR} AS end_ms, count(*) AS n, sum(cents)::BIGINT AS cents FROM {_SLIDING.format(size=6 * HOUR, slide=2 * HOUR)} WHERE start_ms + {6 * HOUR} > ms GROUP BY 1, 2")
def window_sliding_count(spark, d):
    return window_aggregate(events(spark, d), ["event_type"], F.col("ms"), Sliding(6 * HOUR, 2 * HOUR), F.count("*").alias("n"), cents())


GAP_US = 2 * HOUR * 1000
_SESSION_COLUMNS = "min(us) AS first_us, max(us) AS last_us, count(*) AS n, sum(cents)::BIGINT AS cents"
_SESSIONS = """WITH e AS ({e}), g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {gap} THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY {order})),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY {order} ROWS UNBOUNDED PRECEDING)::BIGINT AS session_id FROM g)
SELECT user_id, session_id, {columns} FROM s GROUP BY 1, 2"""


def _session_columns():
    return [F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"), cents()]


@query("session_event_time", _SESSIONS.format(e=_E, gap=GAP_US, order="us, event_id", columns=_SESSION_COLUMNS))
def session_event_time(spark, d):
    return sessions(events(spark, d), ["user_id"], "us", GAP_US, _session_columns(), order=["event_id"])


_ARRIVAL_SESSIONS = _SESSIONS.format(e=_E, gap=GAP_US, order="arr, event_id", columns=_SESSION_COLUMNS)


@query("session_arrival_order", _ARRIVAL_SESSIONS)
def session_arrival_order(spark, d):
    return sessions(events(spark, d), ["user_id"], "us", GAP_US, _session_columns(), "arrival", ARRIVAL)


@query("session_active", f"SELECT user_id, session_id, first_us, last_us, n, cents FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session_id DESC) AS r FROM ({_ARRIVAL_SESSIONS})) WHERE r = 1")
def session_active(spark, d):
    return active_sessions(session_arrival_order(spark, d), ["user_id"])


_WM = f"WITH e AS ({_E}), m AS (SELECT *, max(ms) OVER (ORDER BY arr, event_id ROWS UNBOUNDED PRECEDING) - {{delay}} AS watermark_ms FROM e)"
MINUTE = 60_000


@query("watermark_running", _WM.format(delay=MINUTE) + " SELECT event_id, watermark_ms FROM m")
def watermark_running(spark, d):
    return with_watermark(events(spark, d), "ms", ARRIVAL, MINUTE).select("event_id", "watermark_ms")


@query("watermark_late_rows", _WM.format(delay=HOUR) + f" SELECT event_id, ms // {HOUR} * {HOUR} AS start_ms, watermark_ms FROM m WHERE ms // {HOUR} * {HOUR} + {HOUR} < watermark_ms")
def watermark_late_rows(spark, d):
    return split_late(events(spark, d), "ms", ARRIVAL, Tumbling(HOUR), HOUR)[1].select("event_id", "start_ms", "watermark_ms")


@query("watermark_on_time_agg", _WM.format(delay=HOUR) + f" SELECT user_id, ms // {HOUR} * {HOUR} AS start_ms, count(*) AS n, sum(cents)::BIGINT AS cents FROM m WHERE ms // {HOUR} * {HOUR} + {HOUR} >= watermark_ms GROUP BY 1, 2")
def watermark_on_time_agg(spark, d):
    on_time, _ = split_late(events(spark, d), "ms", ARRIVAL, Tumbling(HOUR), HOUR)
    return on_time.groupBy("user_id", "start_ms").agg(F.count("*").alias("n"), cents())


@query("watermark_no_delay", f"SELECT count(*) AS n FROM ({_E})")
def watermark_no_delay(spark, d):
    return split_late(events(spark, d), "ms", ARRIVAL, Tumbling(HOUR), 0)[0].agg(F.count("*").alias("n"))


@query(
    "watermark_sliding_late_copies",
    _WM.format(delay=MINUTE) + f", s AS (SELECT *, ms // {HOUR} * {HOUR} - {HOUR} * unnest(range(3)) AS start_ms FROM m) SELECT event_id, start_ms FROM s WHERE start_ms + {3 * HOUR} > ms AND start_ms + {3 * HOUR} < watermark_ms",
)
def watermark_sliding_late_copies(spark, d):
    return split_late(events(spark, d), "ms", ARRIVAL, Sliding(3 * HOUR, HOUR), MINUTE)[1].select("event_id", "start_ms")


# Aggregation and state

AS_OF = 1_706_400_000_000
NOW = AS_OF
_CLAIMS = f"SELECT user_id % 16 AS partition, event_id % 5 AS node_id, ms AS claimed_ms, ms + 7200000 * (1 + event_id % 7) AS expires_ms FROM ({_E})"
_LEASES = f"""SELECT partition, h.n AS node_id, h.x AS expires_ms FROM (SELECT partition, list_reduce(list_prepend({{'c': 0::BIGINT, 'n': -1::BIGINT, 'x': 0::BIGINT}},
    list({{'c': claimed_ms::BIGINT, 'n': node_id::BIGINT, 'x': expires_ms::BIGINT}} ORDER BY claimed_ms, node_id, expires_ms)), lambda s, r: CASE WHEN s.x <= r.c OR s.n = r.n THEN r ELSE s END) AS h
    FROM ({_CLAIMS}) WHERE claimed_ms <= {NOW} GROUP BY partition) WHERE h.x > {NOW}"""


@query("fold_ordered", f"WITH e AS ({_E}) SELECT user_id, list_reduce(list_prepend(7::BIGINT, list(cents ORDER BY arr, event_id)), lambda s, x: (s * 31 + x) % 1000003) AS state FROM e GROUP BY 1")
def fold_ordered(spark, d):
    return ordered_fold(events(spark, d), ["user_id"], ARRIVAL, ["cents"], F.lit(7).cast("long"), lambda s, r: (s * 31 + r["cents"]) % 1000003)


@query("fold_conversation", "SELECT conv_id, list_reduce(list_prepend('', list(role ORDER BY turn)), lambda s, x: s || substr(x, 1, 1)) AS turns FROM conversations GROUP BY 1")
def fold_conversation(spark, d):
    return ordered_fold(table(spark, d, "conversations"), ["conv_id"], ["turn"], ["role"], F.lit(""), lambda s, r: F.concat(s, F.substring(r["role"], 1, 1)), "turns")


@query("wordcount", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def wordcount(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


@query("key_running_sum", f"SELECT event_id, sum(cents) OVER (PARTITION BY user_id ORDER BY arr, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM ({_E})")
def key_running_sum(spark, d):
    return state.running(events(spark, d), ["user_id"], ARRIVAL, "total", F.sum("cents")).select("event_id", "total")


_PUTS = f"SELECT user_id, cents, event_id AS seq, ms AS put_ms, CASE WHEN event_id % 3 <> 0 THEN 86400 END AS ttl_s, event_id % 11 = 0 AS gone FROM ({_E})"


def puts(spark, d):
    return events(spark, d).select("user_id", "cents", F.col("event_id").alias("seq"), F.col("ms").alias("put_ms"), F.when(F.col("event_id") % 3 != 0, F.lit(86400)).cast("long").alias("ttl_s"), (F.col("event_id") % 11 == 0).alias("gone"))


_LAST = f"SELECT * FROM ({_PUTS}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1"


@query("state_lww", f"SELECT user_id, cents, seq FROM ({_LAST})")
def state_lww(spark, d):
    return state.latest(puts(spark, d), ["user_id"], "seq").select("user_id", "cents", "seq")


@query("state_delete", f"SELECT user_id, seq FROM ({_LAST}) WHERE NOT gone")
def state_delete(spark, d):
    return state.latest(puts(spark, d), ["user_id"], "seq", "gone").select("user_id", "seq")


@query("state_put_batch", f"SELECT user_id, cents + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS cents FROM ({_LAST})")
def state_put_batch(spark, d):
    now = state.latest(puts(spark, d), ["user_id"], "seq")
    more = now.where("user_id % 2 = 0").withColumn("seq", F.col("seq") + 1).withColumn("cents", F.col("cents") + 1)
    return state.put_batch(now, more, ["user_id"], "seq").select("user_id", "cents")




@query("state_ttl_asof", f"SELECT user_id, seq FROM ({_LAST}) WHERE ttl_s IS NULL OR {AS_OF} <= put_ms + ttl_s * 1000")
def state_ttl_asof(spark, d):
    return state.alive(state.latest(puts(spark, d), ["user_id"], "seq"), "put_ms", "ttl_s", AS_OF).select("user_id", "seq")


@query("state_get_default", f"SELECT c_custkey AS user_id, coalesce(cents, -1) AS cents FROM customer LEFT JOIN ({_LAST}) l ON l.user_id = c_custkey")
def state_get_default(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return state.get(wanted, state.latest(puts(spark, d), ["user_id"], "seq"), ["user_id"], "cents", F.lit(-1).cast("long")).select("user_id", "cents")


@query(
    "state_lookup",
    f"""WITH c AS ({_CRC_TABLE}), k AS (SELECT c_custkey AS user_id, list_transform(range(1, strlen(c_custkey::VARCHAR) + 1), lambda i: ord(substr(c_custkey::VARCHAR, i, 1))::BIGINT) AS bytes FROM customer),
p AS (SELECT user_id, (xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295::BIGINT) % 16)::INT AS partition FROM k, c)
SELECT p.user_id, p.partition, n.node_id, l.cents AS value, l.user_id IS NOT NULL AS found FROM p LEFT JOIN ({_LAST}) l ON l.user_id = p.user_id LEFT JOIN ({_LEASES}) n ON n.partition = p.partition""",
)
def state_lookup(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    leases = cluster.live_leases(claims(spark, d), NOW)
    return state.lookup(wanted, state.latest(puts(spark, d), ["user_id"], "seq"), "user_id", "cents", 16, leases).select("user_id", "partition", "node_id", "value", "found")


@query("state_keys", f"SELECT 'events:' || user_id || ':' || n AS key FROM (SELECT user_id, count(*) AS n FROM ({_E}) GROUP BY 1)")
def state_keys(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).select(F.concat_ws(":", F.lit("events"), K.key_or_default(F.col("user_id")), F.col("n")).alias("key"))


@query("checkpoint_latest", "SELECT event_type AS stream, 'g' || (user_id % 4) AS \"group\", max_by(event_id, event_id + (event_id * 31) % 97 + event_id / 1e9) AS msg_id FROM events GROUP BY 1, 2")
def checkpoint_latest(spark, d):
    commits = events(spark, d).select(F.col("event_type").alias("stream"), F.concat(F.lit("g"), F.col("user_id") % 4).alias("group"), F.col("event_id").alias("msg_id"), F.struct("arr", "event_id").alias("seq"))
    return state.checkpoints(commits, "seq")


@query("checkpoint_skip", "WITH c AS (SELECT user_id % 4 AS p, max(event_id) // 2 AS mark FROM events WHERE user_id % 4 < 3 GROUP BY 1) SELECT event_id FROM events LEFT JOIN c ON c.p = user_id % 4 WHERE mark IS NULL OR event_id > mark")
def checkpoint_skip(spark, d):
    e = table(spark, d, "events").withColumn("p", F.col("user_id") % 4)
    marks = e.where("p < 3").groupBy("p").agg(F.floor(F.max("event_id") / 2).alias("at"))
    return state.after_checkpoint(e, marks, ["p"], "event_id", "at").select("event_id")


@query("read_batch", "SELECT event_id, user_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 10")
def read_batch(spark, d):
    return delivery.read_batch(table(spark, d, "events"), 500, 10, "event_id").select("event_id", "user_id")


# Joins


def _sides(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ms", "event_type")
    return e.where("event_type = 'signup'"), e.where("event_type = 'purchase'")


_SIDES = f"WITH e AS ({_E}), l AS (SELECT * FROM e WHERE event_type = 'signup'), r AS (SELECT * FROM e WHERE event_type = 'purchase')"


@query("join_window_tumbling", _SIDES + f" SELECT l.user_id, l.ms // {HOUR} * {HOUR} AS start_ms, l.event_id AS left_id, r.event_id AS right_id FROM l JOIN r ON l.user_id = r.user_id AND l.ms // {HOUR} = r.ms // {HOUR}")
def join_window_tumbling(spark, d):
    joined = windowed_join(*_sides(spark, d), ["user_id"], "ms", "ms", Tumbling(HOUR))
    return joined.select("user_id", "start_ms", F.col("left.event_id").alias("left_id"), F.col("right.event_id").alias("right_id"))


@query(
    "join_window_sliding",
    _SIDES + f", x AS (SELECT *, ms // {2 * HOUR} * {2 * HOUR} - {2 * HOUR} * unnest(range(3)) AS start_ms FROM e) SELECT a.user_id, a.start_ms, a.event_id AS left_id, b.event_id AS right_id FROM x a JOIN x b ON a.user_id = b.user_id AND a.start_ms = b.start_ms AND a.event_type = 'signup' AND b.event_type = 'purchase'",
)
def join_window_sliding(spark, d):
    joined = windowed_join(*_sides(spark, d), ["user_id"], "ms", "ms", Sliding(6 * HOUR, 2 * HOUR))
    return joined.select("user_id", "start_ms", F.col("left.event_id").alias("left_id"), F.col("right.event_id").alias("right_id"))


@query(
    "join_merge_function",
    _SIDES + f" SELECT l.user_id, l.ms // {HOUR} * {HOUR} AS start_ms, l.event_id * 100000 + r.event_id AS pair FROM l JOIN r ON l.user_id = r.user_id AND l.ms // {HOUR} = r.ms // {HOUR} WHERE (l.event_id + r.event_id) % 3 <> 0",
)
def join_merge_function(spark, d):
    merge = lambda a, b: F.when((a["event_id"] + b["event_id"]) % 3 != 0, a["event_id"] * 100_000 + b["event_id"])
    return windowed_join(*_sides(spark, d), ["user_id"], "ms", "ms", Tumbling(HOUR), merge, "pair").select("user_id", "start_ms", "pair")


@query("join_session_equal_times", "SELECT a.o_orderkey AS left_id, b.o_orderkey AS right_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey")
def join_session_equal_times(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", epoch_millis(F.col("o_orderdate")).alias("ms"))
    joined = windowed_join(o, o, ["o_custkey"], "ms", "ms", Session(HOUR))
    return joined.select(F.col("left.o_orderkey").alias("left_id"), F.col("right.o_orderkey").alias("right_id")).where("left_id < right_id")


# Sinks and delivery

_DUPLICATES = "SELECT event_id, user_id, event_id AS seq FROM events UNION ALL SELECT event_id, user_id, event_id + 1000000 FROM events WHERE event_id % 10 = 0"


def duplicates(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("event_id").alias("seq"))
    return e.unionByName(e.where("event_id % 10 = 0").withColumn("seq", F.col("seq") + 1_000_000))


@query("sink_idempotent", f"SELECT event_id, 'tidemark:sink:main:' || event_id AS token, min(seq) AS seq FROM ({_DUPLICATES}) GROUP BY 1, 2")
def sink_idempotent(spark, d):
    return sinks.with_token(sinks.first_writes(duplicates(spark, d), ["event_id"], "seq"), "main", F.col("event_id")).select("event_id", "token", "seq")


@query("sink_new_tokens", "SELECT event_id FROM events WHERE event_id % 7 <> 0")
def sink_new_tokens(spark, d):
    e = sinks.with_token(table(spark, d, "events").select("event_id"), "main", F.col("event_id"))
    return sinks.new_tokens(e, e.where("event_id % 7 = 0")).select("event_id")


DAY = 86_400_000


WRITES_WITH_TTL = f"""WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events),
w AS (SELECT user_id, event_type, min(ms) AS ms FROM e GROUP BY 1, 2 UNION ALL
      SELECT w.user_id, w.event_type, (SELECT min(e.ms) FROM e WHERE e.user_id = w.user_id AND e.event_type = w.event_type AND e.ms > w.ms + {DAY}) AS ms FROM w WHERE w.ms IS NOT NULL)
SELECT * FROM w WHERE ms IS NOT NULL"""


@query("sink_idempotent_ttl", WRITES_WITH_TTL)
def sink_idempotent_ttl(spark, d):
    return sinks.writes_with_ttl(events(spark, d), ["user_id", "event_type"], "ms", DAY)


_ATTEMPTS = "SELECT event_id, 1 + event_id % 5 AS attempts FROM events WHERE event_type = 'error'"


def attempts(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").withColumn("attempts", 1 + F.col("event_id") % 5)


@query("retry_outcome", f"SELECT event_id, CASE WHEN attempts > 3 THEN 'dead_letter' ELSE 'retry' END AS outcome FROM ({_ATTEMPTS})")
def retry_outcome(spark, d):
    return delivery.retry_outcomes(attempts(spark, d)).select("event_id", "outcome")


@query("backoff_delay", f"SELECT attempts, pow(2, attempts - 1)::DOUBLE AS backoff_s, count(*) AS n FROM ({_ATTEMPTS}) GROUP BY 1, 2")
def backoff_delay(spark, d):
    return delivery.retry_outcomes(attempts(spark, d)).groupBy("attempts", "backoff_s").agg(F.count("*").alias("n"))


@query("retry_counter_cleared", "SELECT user_id AS msg_id, count(*) AS attempts FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events a WHERE a.user_id = e.user_id AND a.event_type = 'purchase' AND a.user_id % 2 = 0 AND a.event_id >= e.event_id) GROUP BY 1")
def retry_counter_cleared(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "msg_id")
    return delivery.attempt_counts(e.where("event_type = 'error'"), e.where("event_type = 'purchase' AND msg_id % 2 = 0"), seq="event_id")


_DLQ = f"SELECT event_id, 'failed ' || attempts AS _error, 'events' AS _original_stream, event_id::VARCHAR AS _original_msg_id, (event_id * 1000)::VARCHAR AS _moved_timestamp FROM ({_ATTEMPTS}) WHERE attempts > 3"


def dlq(spark, d):
    bad = attempts(spark, d).where("attempts > 3")
    made = delivery.dead_letters(bad, F.concat(F.lit("failed "), F.col("attempts")), F.lit("events"), F.col("event_id"), F.col("event_id") * 1000)
    return made.select("event_id", "_error", "_original_stream", "_original_msg_id", "_moved_timestamp")


@query("dlq_records", _DLQ)
def dlq_records(spark, d):
    return dlq(spark, d)


@query("dlq_inspect", f"SELECT event_id, _error FROM ({_DLQ}) ORDER BY event_id LIMIT 10")
def dlq_inspect(spark, d):
    return dlq(spark, d).orderBy("event_id").limit(10).select("event_id", "_error")


@query("dlq_replay", f"SELECT event_id FROM ({_DLQ}) ORDER BY event_id LIMIT 100")
def dlq_replay(spark, d):
    return delivery.replay(dlq(spark, d), "event_id", 100)[0]


@query("dlq_rest", f"SELECT event_id FROM ({_DLQ}) ORDER BY event_id OFFSET 100")
def dlq_rest(spark, d):
    return delivery.replay(dlq(spark, d), "event_id", 100)[1].select("event_id")


@query("offset_commit", "SELECT user_id % 4 AS partition, max(event_id) + 1 AS committed FROM events WHERE event_type <> 'error' GROUP BY 1")
def offset_commit(spark, d):
    acked = table(spark, d, "events").where("event_type <> 'error'").withColumn("partition", F.col("user_id") % 4)
    return delivery.commits(acked, ["partition"], "event_id")


_LAG = "SELECT user_id % 4 AS partition, max(event_id) + 1 AS \"end\", CASE WHEN user_id % 4 < 3 THEN max(event_id) // 2 END AS committed FROM events GROUP BY 1"


def lags(spark, d):
    ends = table(spark, d, "events").groupBy((F.col("user_id") % 4).alias("partition")).agg((F.max("event_id") + 1).alias("end"))
    committed = ends.where("partition < 3").select("partition", F.floor((F.col("end") - 1) / 2).alias("committed"))
    return delivery.lag(ends, committed, ["partition"])


@query("consumer_lag", f"SELECT partition, greatest(0, \"end\" - coalesce(committed, 0)) AS lag FROM ({_LAG})")
def consumer_lag(spark, d):
    return lags(spark, d).select("partition", "lag")


@query("claim_stuck", f"SELECT event_id FROM ({_E}) WHERE event_type = 'error' AND {AS_OF} - ms >= 60000 ORDER BY event_id LIMIT 50")
def claim_stuck(spark, d):
    return delivery.claim_stuck(events(spark, d).where("event_type = 'error'"), AS_OF, "ms", "event_id").select("event_id")


@query("offset_reset", "SELECT 'g' || (user_id % 3) AS \"group\", user_id % 4 AS partition, CASE WHEN user_id % 3 = 1 THEN 0 ELSE max(event_id) END AS committed FROM events GROUP BY user_id % 3, user_id % 4")
def offset_reset(spark, d):
    offsets = table(spark, d, "events").groupBy(F.concat(F.lit("g"), F.col("user_id") % 3).alias("group"), (F.col("user_id") % 4).alias("partition")).agg(F.max("event_id").alias("committed"))
    return delivery.reset_offsets(offsets, "g1", "0")


# Commit log

_LOG = f"SELECT *, user_id % 4 AS partition, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS \"offset\" FROM ({_E})"


_WRITTEN: dict[tuple[str, str], commit_log.CommitLog] = {}


def written(spark, d) -> commit_log.CommitLog:
    """The log of a directory's events, appended in two parts, once for an application."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _WRITTEN:
        made = commit_log.CommitLog(spark, new_path(spark, "log", listed=False))
        for part in (F.col("event_id") <= 700, F.col("event_id") > 700):
            made.append(events(spark, d).where(part), F.col("user_id"), ["event_id"], F.col("user_id") % 4)
        _WRITTEN[at] = made
    return _WRITTEN[at]


def log(spark, d):
    return written(spark, d).read()


@query("log_offsets", f"SELECT event_id, partition, \"offset\" FROM ({_LOG})")
def log_offsets(spark, d):
    return log(spark, d).select("event_id", "partition", "offset")


@query("high_watermark", f"SELECT partition, max(\"offset\") + 1 AS high_watermark FROM ({_LOG}) GROUP BY 1")
def high_watermark(spark, d):
    return written(spark, d).high_watermarks()


@query("log_scan", f"SELECT event_id, \"offset\" FROM ({_LOG}) WHERE partition = 1 AND \"offset\" >= 1000")
def log_scan(spark, d):
    return commit_log.scan(log(spark, d), 1, 1000).select("event_id", "offset")


@query("log_head", f"SELECT event_id, \"offset\" FROM ({_LOG}) WHERE partition = 2 ORDER BY \"offset\" LIMIT 10")
def log_head(spark, d):
    return commit_log.head(log(spark, d), 2).select("event_id", "offset")


@query("log_tail", f"SELECT event_id, partition, \"offset\" FROM ({_LOG}) QUALIFY \"offset\" >= max(\"offset\") OVER (PARTITION BY partition) + 1 - 10")
def log_tail(spark, d):
    return commit_log.tail(log(spark, d)).select("event_id", "partition", "offset")


@query("log_trim", f"SELECT event_id, partition FROM ({_LOG}) QUALIFY \"offset\" >= max(\"offset\") OVER (PARTITION BY partition) + 1 - 500")
def log_trim(spark, d):
    return commit_log.tail(log(spark, d), 500).select("event_id", "partition")


@query(
    "log_retention",
    f"""WITH l AS (SELECT *, "offset" // 100 AS segment FROM ({_LOG})), s AS (SELECT partition, segment, max(ms) AS written FROM l GROUP BY 1, 2),
k AS (SELECT *, max(segment) OVER (PARTITION BY partition) AS active FROM s) SELECT event_id FROM l JOIN k USING (partition, segment) WHERE segment = active OR written >= {AS_OF} - 7 * {DAY}""",
)
def log_retention(spark, d):
    return commit_log.retained(log(spark, d), F.floor(F.col("offset") / 100), "ms", AS_OF - 7 * DAY).select("event_id")


@query("log_recover_prefix", f"WITH l AS ({_LOG}), b AS (SELECT partition, min(\"offset\") AS bad FROM l WHERE event_id % 997 = 5 GROUP BY 1) SELECT event_id FROM l LEFT JOIN b USING (partition) WHERE bad IS NULL OR \"offset\" < bad")
def log_recover_prefix(spark, d):
    return commit_log.recovered(log(spark, d), F.col("event_id") % 997 != 5).select("event_id")


@query("replica_catchup", f"WITH l AS ({_LOG}), f AS (SELECT partition, max(\"offset\") + 1 AS hw FROM l WHERE \"offset\" < 50 * (partition + 1) AND partition < 3 GROUP BY 1) SELECT event_id FROM l LEFT JOIN f USING (partition) WHERE \"offset\" >= coalesce(hw, 0) AND \"offset\" < coalesce(hw, 0) + 100")
def replica_catchup(spark, d):
    leader = log(spark, d)
    follower = leader.where((F.col("offset") < 50 * (F.col("partition") + 1)) & (F.col("partition") < 3))
    return commit_log.catch_up(leader, follower).select("event_id")


# Cluster


def claims(spark, d):
    e = events(spark, d)
    return e.select((F.col("user_id") % 16).alias("partition"), (F.col("event_id") % 5).alias("node_id"), F.col("ms").alias("claimed_ms"), (F.col("ms") + 7_200_000 * (1 + F.col("event_id") % 7)).alias("expires_ms"))


def nodes(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("host"), (9000 + F.col("s_nationkey")).alias("port"))


_NODES = "SELECT s_suppkey AS node_id, s_name AS host, 9000 + s_nationkey AS port FROM supplier"


@query("lease_acquire", _LEASES)
def lease_acquire(spark, d):
    return cluster.live_leases(claims(spark, d), NOW)


@query("fair_share", f"WITH l AS ({_LEASES}), n AS ({_NODES}), h AS (SELECT n.node_id, count(l.partition) AS held FROM n LEFT JOIN l USING (node_id) GROUP BY 1), t AS (SELECT (SELECT count(DISTINCT partition) FROM l) // greatest((SELECT count(*) FROM n), 1) + 1 AS share, (SELECT count(*) FROM n) AS c) SELECT node_id, held, share AS fair_share, (held > share AND c > 1)::INT AS release FROM h, t")
def fair_share(spark, d):
    return cluster.fair_share(cluster.live_leases(claims(spark, d), NOW), nodes(spark, d))


@query("leader_lookup", f"SELECT partition, node_id, host, port FROM ({_LEASES}) JOIN ({_NODES}) USING (node_id)")
def leader_lookup(spark, d):
    return cluster.leaders(cluster.live_leases(claims(spark, d), NOW), nodes(spark, d))


@query("cluster_peers", f"SELECT node_id, host FROM ({_NODES}) WHERE node_id <> 3")
def cluster_peers(spark, d):
    return cluster.peers(nodes(spark, d), 3).select("node_id", "host")


@query("cluster_status", f"SELECT node_id, coalesce(string_agg(partition::VARCHAR, ',' ORDER BY partition), '') AS held FROM ({_NODES}) LEFT JOIN ({_LEASES}) USING (node_id) GROUP BY 1")
def cluster_status(spark, d):
    rows = cluster.status(cluster.live_leases(claims(spark, d), NOW), nodes(spark, d))
    return rows.select("node_id", F.array_join(F.col("partitions").cast("array<string>"), ",").alias("held"))


# Metrics

_OUT = f"SELECT 'user' || (user_id % 3) AS stream, CASE WHEN event_type <> 'error' THEN 'success' WHEN event_id % 5 > 2 THEN 'dead_letter' ELSE 'error' END AS status, cents / 10000.0 AS seconds, ms FROM ({_E})"


def outcomes(spark, d):
    status = F.when(F.col("event_type") != "error", "success").when(F.col("event_id") % 5 > 2, "dead_letter").otherwise("error")
    return events(spark, d).select(F.concat(F.lit("user"), F.col("user_id") % 3).alias("stream"), status.alias("status"), (F.col("cents") / 10000.0).alias("seconds"), "ms")


@query("metrics_status", f"SELECT stream, s AS status, count(*) AS total FROM (SELECT stream, unnest(CASE WHEN status = 'dead_letter' THEN ['error', 'dead_letter'] ELSE [status] END) AS s FROM ({_OUT})) GROUP BY 1, 2")
def metrics_status(spark, d):
    return metrics.processed(outcomes(spark, d))


@query(
    "metrics_histogram",
    "WITH o AS (" + _OUT + ") " + " UNION ALL ".join(f"SELECT stream, '{b}' AS le, count(*) FILTER (seconds <= {b}) AS n FROM o WHERE status = 'success' GROUP BY 1" for b in metrics.BUCKETS) + " UNION ALL SELECT stream, '+Inf', count(*) FROM o WHERE status = 'success' GROUP BY 1",
)
def metrics_histogram(spark, d):
    return metrics.histogram(outcomes(spark, d), "seconds")


@query("metrics_rate", f"SELECT stream, status, ms // {DAY} * {DAY} AS at_ms, count(*) AS n FROM ({_OUT}) GROUP BY 1, 2, 3")
def metrics_rate(spark, d):
    rows = metrics.rates(outcomes(spark, d), F.col("ms"), DAY)
    return rows.select("stream", "status", "at_ms", F.round(F.col("per_second") * DAY / 1000).cast("long").alias("n"))


@query("alert_error_ratio", f"SELECT stream, ms // {DAY} * {DAY} AS at_ms, count(*) FILTER (status <> 'success') AS errors, count(*) AS total, count(*) FILTER (status <> 'success') > count(*) * 0.05::DOUBLE AS firing FROM ({_OUT}) GROUP BY 1, 2")
def alert_error_ratio(spark, d):
    return metrics.error_ratio(outcomes(spark, d), F.col("ms"), DAY)


@query("alert_lag", f"SELECT partition, greatest(0, \"end\" - coalesce(committed, 0)) > 1000 AS firing FROM ({_LAG})")
def alert_lag(spark, d):
    return metrics.lag_alert(lags(spark, d)).select("partition", "firing")


@query(
    "metrics_p95",
    f"""WITH o AS ({_OUT}), b AS (SELECT stream, le, count(*) FILTER (seconds <= le) AS n FROM o, (VALUES (0.01), (0.05), (0.1), (0.5), (1.0), (5.0)) v(le) WHERE status = 'success' GROUP BY 1, 2
UNION ALL SELECT stream, 1e9, count(*) FROM o WHERE status = 'success' GROUP BY 1),
r AS (SELECT stream, max(n) * 0.95::DOUBLE AS rank FROM b GROUP BY 1),
x AS (SELECT b.*, rank, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS below FROM b JOIN r USING (stream) WINDOW w AS (PARTITION BY stream ORDER BY le)),
f AS (SELECT * FROM x WHERE n >= rank QUALIFY row_number() OVER (PARTITION BY stream ORDER BY le) = 1)
SELECT stream, round(CASE WHEN le > 1e8 THEN low ELSE low::DOUBLE + (le::DOUBLE - low::DOUBLE) * (rank - below) / (n - below) END::DOUBLE, 6) AS value FROM f""",
)
def metrics_p95(spark, d):
    return metrics.quantile(metrics.histogram(outcomes(spark, d), "seconds"), ["stream"], 0.95).select("stream", F.round("value", 6).alias("value"))


@query("offset_injection", "SELECT event_id, (user_id % 4) || '-' || event_id AS \"offset\" FROM events")
def offset_injection(spark, d):
    e = table(spark, d, "events")
    return V.with_offset(e, F.concat_ws("-", F.col("user_id") % 4, F.col("event_id"))).select("event_id", "offset")


_RECORDS = "SELECT event_id, user_id % 16 AS partition FROM events"


@query("replicated_append", f"SELECT event_id, partition FROM ({_RECORDS}) WHERE partition IN (SELECT partition FROM ({_LEASES}) WHERE node_id = 2)")
def replicated_append(spark, d):
    records = table(spark, d, "events").select("event_id", (F.col("user_id") % 16).alias("partition"))
    return cluster.accepted_appends(records, cluster.live_leases(claims(spark, d), NOW), 2)[0].select("event_id", "partition")


@query("replicated_append_refused", f"SELECT event_id, 'Not leader for partition ' || partition AS _error FROM ({_RECORDS}) WHERE partition NOT IN (SELECT partition FROM ({_LEASES}) WHERE node_id = 2)")
def replicated_append_refused(spark, d):
    records = table(spark, d, "events").select("event_id", (F.col("user_id") % 16).alias("partition"))
    return cluster.accepted_appends(records, cluster.live_leases(claims(spark, d), NOW), 2)[1].select("event_id", "_error")
