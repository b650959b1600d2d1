"""Numbered items of a service as a table and as a stream."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from quarrylight.sources import remote

SCHEMA = "id long, name string"


@pytest.fixture
def service():
    """Items by number, with gaps; every third request breaks once."""
    items, asked, broken = {}, [], set()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            if len(asked) % 3 == 0 and self.path not in broken:
                broken.add(self.path)
                return self.send_error(503)
            url = urlparse(self.path)
            if url.path == "/newest":
                answer = max(items, default=0)
            elif url.path == "/items":
                span = {k: int(v[0]) for k, v in parse_qs(url.query).items()}
                answer = [{"id": n, "name": v} for n, v in items.items() if span["after"] < n <= span["upto"]]
            else:
                return self.send_error(404)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", items, asked
    server.shutdown()


def test_table(spark, service):
    url, items, asked = service
    remote.register(spark, "listing", remote.HttpClient(url, ["id", "name"]), SCHEMA)
    assert spark.read.format("listing").load().collect() == []
    items.update({n: f"item {n}" for n in range(1, 260) if n % 7})
    items[300] = None
    read = lambda **o: sorted(map(tuple, spark.read.format("listing").options(**o).load().collect()))
    assert read(page=50) == sorted(items.items())
    assert len({p for p in asked if "items" in p}) == 6
    assert read(page=50, pages=2) == sorted((n, v) for n, v in items.items() if n <= 100)
    assert read(page=64, after=200) == sorted((n, v) for n, v in items.items() if n > 200)
    with pytest.raises(Exception, match="404"):
        client = remote.HttpClient(f"{url}/elsewhere", ["id"])
        client.newest()


def test_a_restarted_stream_goes_on_behind_its_offset(spark, service, tmp_path):
    url, items, asked = service
    remote.register(spark, "updates", remote.HttpClient(url, ["id", "name"]), SCHEMA)

    def run():
        stream = spark.readStream.format("updates").option("page", 40).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect()))

    items.update({n: f"first {n}" for n in range(1, 101)})
    assert run() == sorted(items.items())
    del asked[:]
    items.update({n: f"second {n}" for n in range(103, 150)})
    assert run() == sorted(items.items())
    spans = [parse_qs(urlparse(p).query) for p in asked if "items" in p]
    assert spans and all(int(s["after"][0]) >= 100 for s in spans)
    assert run() == sorted(items.items())
