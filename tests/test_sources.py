"""Version log, pages over HTTP and the stream of shards, with failures thrown in."""

from __future__ import annotations

import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from siftlake.sources import http
from siftlake.sources import tables as S


def test_two_writers_give_one_winner(spark, tmp_path):
    v = S.Versions(spark, f"file://{tmp_path}/c")
    assert v.adopt(spark.range(3), "v1") == 0
    results, gate = [], threading.Barrier(2)

    def writer(name, n):
        own = S.Versions(spark, f"file://{tmp_path}/c")
        plain = own.write
        own.write = lambda rows: (plain(rows), gate.wait(60))[0]  # both have written their data before either commits
        try:
            results.append(own.adopt(spark.range(n), name))
        except S.Conflict as e:
            results.append(e)

    threads = [threading.Thread(target=writer, args=a) for a in (("v2", 5), ("v3", 7))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(type(r).__name__ for r in results) == ["Conflict", "int"]
    assert v.steps() == [0, 1]
    assert v.read().count() == {"v2": 5, "v3": 7}[v.active()]
    loser = ({"v2", "v3"} - {v.active()}).pop()
    assert v.adopt(spark.range(9), loser) == 2  # and its name is free
    assert v.revert() in ("v2", "v3") and v.revert() == "v1"
    assert [v.read(step=k).count() for k in (0, 2, 4)] == [3, 9, 3]
    with pytest.raises(ValueError):
        v.revert()
    with pytest.raises(ValueError):
        v.adopt(spark.range(1), "v1")
    with pytest.raises(S.Conflict):
        v.adopt(spark.range(1), "v9", after=0)


def test_a_writer_that_dies_leaves_the_versions_as_they_were(spark, tmp_path, monkeypatch):
    v = S.Versions(spark, str(tmp_path / "c"))
    v.adopt(spark.range(3), "v1")
    with monkeypatch.context() as m:
        m.setattr(v, "_commit", lambda *a, **b: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            v.adopt(spark.range(5), "v2")
    assert (v.active(), v.read().count(), v.steps()) == ("v1", 3, [0])
    v.adopt(spark.range(6), "v2")
    assert (v.active(), v.read().count()) == ("v2", 6)


@pytest.fixture
def server(spark):
    """Serves the pages table; every third page fails twice first, /gone is missing, /down always fails."""
    pages = {f"/{r.page_id}": r.html.encode() for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(12).collect()}
    seen: dict = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            n = seen[self.path] = seen.get(self.path, 0) + 1
            page = pages.get(self.path)
            code = 503 if self.path == "/down" or (page and int(self.path[1:]) % 3 == 0 and n <= 2) else 404 if page is None else 200
            tag = f'"{hashlib.md5(page).hexdigest()}"' if page else None
            if code == 200 and self.headers.get("If-None-Match") == tag:
                code = 304
            self.send_response(code)
            if tag:
                self.send_header("ETag", tag)
            self.end_headers()
            if code == 200:
                self.wfile.write(page)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", pages, seen
    s.shutdown()


def test_pages_over_http(spark, server, tmp_path):
    base, pages, seen = server
    http.register(spark)
    urls = [base + p for p in pages] + [f"{base}/gone", f"{base}/down"]
    first = next(iter(pages))

    def load(**more):
        reader = spark.read.format("http_pages").option("urls", json.dumps(urls)).option("pause", "0.01").option("tries", "3").option("partitions", "3").option("cache", f"file://{tmp_path}/cache")
        for k, v in more.items():
            reader = reader.option(k, v)
        return {r.url: r for r in reader.load().collect()}

    got = load()
    for p, page in pages.items():
        r = got[base + p]
        assert (r.status, bytes(r.content), r.sha256) == ("fetched", page, hashlib.sha256(page).hexdigest())
        assert r.tries == (3 if int(p[1:]) % 3 == 0 else 1)
    assert (got[f"{base}/gone"].status, got[f"{base}/gone"].tries, got[f"{base}/gone"].error) == ("failed", 1, "HTTP 404")
    assert (got[f"{base}/down"].status, got[f"{base}/down"].tries) == ("failed", 3)
    again = load(expected=json.dumps({base + first: "0" * 64}))
    assert again[base + first].status == "drifted" and again[base + first].content is None
    assert all(again[base + p].status == "unchanged" and bytes(again[base + p].content) == pages[p] for p in pages if p != first)
    for p in pages:
        seen[p] = -10_000 if int(p[1:]) % 3 == 0 else seen[p]  # these fail from now on
    table = spark.createDataFrame([(u, None) for u in urls[:12]] + [(None, None), ("no address", None)], "url string, want string").repartition(2)
    rows = {r.url: r for r in http.fetched(table, http.Fetcher(tries=2, pause=0.01, cache=f"file://{tmp_path}/cache"), expected="want").collect()}
    assert {rows[base + p].status for p in pages} == {"stale", "unchanged"}
    assert rows[None].status == rows["no address"].status == "failed"


def test_a_shard_that_disagrees_is_refused(spark, tmp_path):
    from siftlake.streaming.shards import HITS, merge_stream, merged_hits, refused_shards

    q = spark.range(4).withColumnRenamed("id", "query_id")
    shards = ([("m", 0.5, k, 1) for k in range(4)], [("n", 0.5, k, 0) for k in range(4)], [("m", 0.5, 0, 1), ("m", 0.5, 1, 0), ("m", 0.5, 2, 0)])

    def drain():
        merge_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", q).awaitTermination(120)
        return sorted(map(tuple, merged_hits(spark, f"{tmp_path}/out").collect()))

    for rows in shards:
        spark.createDataFrame(rows, HITS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        merged = drain()
    assert merged == sorted(shards[0] + shards[1])
    assert [r.rows for r in refused_shards(spark, f"{tmp_path}/out").collect()] == [2]
    spark.createDataFrame(shards[0], HITS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # a shard that comes twice
    assert drain() == merged
    assert refused_shards(spark, f"{tmp_path}/out").agg(F.sum("rows")).first()[0] == 2
