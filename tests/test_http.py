"""The HTTP layer from start to result."""

import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from tablelens.streaming.http import serve


def call(port, path, body=None):
    data = None if body is None else json.dumps(body).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", data), timeout=30) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


@pytest.fixture(scope="module")
def port(spark):
    server = serve(spark)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server.server_port
    server.shutdown()


def test_job_over_http(spark, port, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,name\n1,a\n2,b\n3,b\n")
    assert call(port, "/health") == (200, {"status": "ok"})
    code, started = call(port, "/insights/start", {"path": str(path), "tableName": "t"})
    assert code == 202
    end = time.time() + 90
    while (found := call(port, f"/insights/status?jobId={started['jobId']}")[1])["status"] in ("pending", "running") and time.time() < end:
        time.sleep(0.5)
    assert found["status"] == "complete"
    assert found["result"]["rowCount"] == 3
    assert call(port, "/insights/cancel", {"jobId": "none"}) == (200, {"cancelled": False})
    assert call(port, "/insights/status?jobId=none")[0] == 404
    assert call(port, "/insights/start", {})[0] == 400
    assert call(port, "/other")[0] == 404
    code, bad = call(port, "/insights/start", {"query": "drop table x"})
    while (found := call(port, f"/insights/status?jobId={bad['jobId']}")[1])["status"] in ("pending", "running"):
        time.sleep(0.2)
    assert found["status"] == "error"
