import socketserver
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources import backends
from tidemark.sources.redis_stream import id_of, split
from tidemark.streaming.monitor import Monitor


class Server(socketserver.ThreadingTCPServer):
    """Streams in memory, as much as the source and sink ask for."""

    allow_reuse_address = daemon_threads = True

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.streams, self.lock = {}, threading.Lock()
        self.groups = {}  # (stream, group) -> [position, {id: [consumer, delivered at, deliveries]}]

    def group(self, name, rest, streams):
        now = time.time() * 1000
        if name == "XGROUP":
            key = (rest[1], rest[2])
            if key in self.groups:
                return RuntimeError("BUSYGROUP Consumer Group name already exists")
            self.groups[key] = [id_of(rest[3]), {}]
            return "OK"
        if name == "XREADGROUP":
            group, consumer, count, stream = rest[1], rest[2], int(rest[4]), rest[6]
            state = self.groups[stream, group]
            new = [[i, f] for i, f in streams.get(stream, []) if id_of(i) > state[0]][:count]
            for i, _ in new:
                state[0] = id_of(i)
                state[1][i] = [consumer, now, 1]
            return [[stream, new]] if new else None
        state = self.groups[rest[0], rest[1]]
        if name == "XACK":
            return sum(state[1].pop(i, None) is not None for i in rest[2:])
        if name == "XPENDING":
            rows = [[i, c, int(now - at), n] for i, (c, at, n) in sorted(state[1].items(), key=lambda x: id_of(x[0])) if now - at >= int(rest[3])]
            return rows[: int(rest[6])]
        if name == "XCLAIM":
            out = []
            for i in rest[4:]:
                if i in state[1] and now - state[1][i][1] >= int(rest[3]):
                    state[1][i] = [rest[2], now, state[1][i][2] + 1]
                    out.append([i, dict(streams[rest[0]])[i]])
            return out
        return None


class Handler(socketserver.StreamRequestHandler):
    def handle(self):
        while line := self.rfile.readline():
            words = []
            for _ in range(int(line[1:])):
                size = int(self.rfile.readline()[1:])
                words.append(self.rfile.read(size + 2)[:-2].decode())
            self.wfile.write(encode(self.answer(words)))

    def answer(self, words):
        name, rest = words[0], words[1:]
        with self.server.lock:
            entries = self.server.streams.setdefault(rest[0], [])
            if name == "XADD":
                at = rest.index("*")
                entries.append((f"1000-{len(entries) + 5}", rest[at + 1 :]))
                if at > 1:
                    del entries[: max(0, len(entries) - int(rest[3]))]
                return entries[-1][0]
            if name == "XRANGE":
                low, high, count = id_of(rest[1][1:]), rest[2], int(rest[4])
                return [[i, f] for i, f in entries if id_of(i) > low and (high == "+" or id_of(i) <= id_of(high))][:count]
            if name == "XREVRANGE":
                return [[i, f] for i, f in entries[-1:]]
            return self.server.group(name, rest, self.server.streams)


def encode(x):
    if isinstance(x, list):
        return b"*%d\r\n" % len(x) + b"".join(map(encode, x))
    if isinstance(x, int):
        return b":%d\r\n" % x
    if isinstance(x, RuntimeError):
        return b"-%b\r\n" % str(x).encode()
    return b"$-1\r\n" if x is None else b"$%d\r\n%b\r\n" % (len(x.encode()), x.encode())


@pytest.fixture
def server():
    s = Server()
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def test_ranges_cover_ids_in_order():
    parts = split((5, 3), (100, 7), 4)
    assert parts[0].after == (5, 3) and parts[-1].until == (100, 7)
    assert all(a.until == b.after for a, b in zip(parts, parts[1:], strict=False))
    assert id_of("9-10") > id_of("9-9") and id_of("7") == (7, 0)


def test_batch_and_stream(spark, server, tmp_path):
    topic = backends.open_topic(spark, "orders", "g", "redis", host="127.0.0.1", port=str(server.server_address[1]))
    rows = spark.range(1200, numPartitions=3).select(F.col("id").alias("event_id"), F.struct(F.lit("é").alias("a")).alias("nested"), F.when(F.col("id") > 5, F.lit("x")).alias("maybe"))
    topic.append(rows)
    got = topic.read().collect()
    assert len(got) == 1200 and {int(r.fields["event_id"]) for r in got} == set(range(1200))
    assert got[0].fields["nested"] == '{"a":"é"}' and "" in {r.fields["maybe"] for r in got}
    monitor = Monitor().install(spark)
    out = str(tmp_path / "out")

    def run():
        query = topic.read_stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
        query.awaitTermination()

    run()
    assert spark.read.parquet(out).select("msg_id").distinct().count() == 1200
    topic.append(rows.limit(3))
    run()
    assert spark.read.parquet(out).count() == 1203
    for _ in range(50):
        if sum(monitor.running.values()) == 0 and monitor.running:
            break
        time.sleep(0.1)
    spark.streams.removeListener(monitor)
    seen = monitor.table(spark)
    assert seen.agg(F.sum("rows")).first()[0] == 1203 and seen.where("status = 0").count() == 2
    empty = topic.with_topic("none")
    assert empty.read().count() == 0


def test_groups_acknowledge_and_claim(spark, server):
    """A consumer that dies leaves its entries pending; another claims them after the idle time, and every entry is acknowledged once."""
    topic = backends.open_topic(spark, "orders", "g", "redis", host="127.0.0.1", port=str(server.server_address[1]))
    topic.append(spark.range(25).select(F.col("id").alias("event_id")).coalesce(1))
    topic.ensure_group()
    topic.ensure_group()
    first = topic.read_group("a").collect()
    assert len(first) == 10  # the setting's batch size
    second = topic.read_group("b", 100)
    ids = [r.msg_id for r in first] + [r.msg_id for r in second.collect()]
    assert len(set(ids)) == 25 and topic.read_group("b").count() == 0
    assert topic.ack(second) == 15 and topic.ack(second) == 0
    left = topic.pending().collect()
    assert [r.msg_id for r in left] == [r.msg_id for r in first] and {(r.consumer, r.deliveries) for r in left} == {("a", 1)}
    assert topic.claim_stuck("b").count() == 0  # not idle for a minute
    time.sleep(0.05)
    taken = topic.claim_stuck("b", min_idle_ms=20, count=4)
    assert [r.msg_id for r in taken.collect()] == [r.msg_id for r in first[:4]] and taken.first().fields["event_id"] == "0"
    assert {(r.consumer, r.deliveries) for r in topic.pending().collect()} == {("a", 1), ("b", 2)}
    assert topic.ack(topic.pending()) == 10 and topic.pending().count() == 0
