import io
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from skein import cli
from skein.plans import trace
from skein.plans.config import CrawlConfig
from skein.plans.crawl import crawl
from skein.sources import live, site
from skein.streaming import crawl_streams


def test_trace_of_a_redirect(spark):
    row = lambda path, status, location, body: ("http://e.com" + path, 1, status, "text/html", location, None, None, body, None)
    rows = [row("/", 200, None, "<a href=/r>r</a><a href=http://o.com/>o</a>"), row("/r", 302, "/t", ""), row("/t", 200, None, "<p>t</p>")]
    web = site.web(spark.createDataFrame(rows, site.RESPONSES))
    result = crawl(spark, CrawlConfig(start_url="http://e.com"), web)
    want = """crawl-start url=http://e.com|reserved url=http://e.com/ depth=0 reason=start|take url=http://e.com/ depth=0 sequence=0|attempt-start url=http://e.com/robots.txt attempt=1
robots-check url=http://e.com/ allowed=true|attempt-start url=http://e.com/ attempt=1|links url=http://e.com/ discovered=2|reserved url=http://e.com/r depth=1 reason=discovered
skipped url=http://o.com/ reason=other-origin|commit sequence=0 state=ok|take url=http://e.com/r depth=1 sequence=1|robots-check url=http://e.com/r allowed=true|attempt-start url=http://e.com/r attempt=1
robots-check url=http://e.com/t allowed=true|redirect from=http://e.com/r to=http://e.com/t status=302|attempt-start url=http://e.com/t attempt=1|links url=http://e.com/t discovered=0
commit sequence=1 state=ok|crawl-stop reason=completed"""
    assert trace.text(result) == "".join(f"[trace] {x}\n" for x in want.replace("\n", "|").split("|"))
    heard = []

    def sink(line):
        heard.append(line)
        raise ValueError

    trace.emit(result, sink)
    assert len(heard) == 1


def streamed(spark, tmp_path, batches, schema, build, mode="append"):
    source, name = tmp_path / "in", f"t{abs(hash(str(tmp_path)))}"
    source.mkdir()
    query = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        query = build(spark.readStream.schema(schema).parquet(str(source))).writeStream.format("memory").queryName(name).outputMode(mode)
        if i == 0:
            running = query.option("checkpointLocation", str(tmp_path / "check")).start()
        running.processAllAvailable()
    running.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_streams_keep_their_state(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    got = streamed(spark, tmp_path / "a", [[(1, "http://e.com/a?b=1")], [(2, "HTTP://E.com:80/a?b=1#x"), (3, "http://e.com/c"), (4, "mailto:x")]], "id int, url string", crawl_streams.first_seen)
    assert sorted(r[0] for r in got) == [1, 3]
    got = streamed(spark, tmp_path / "b", [[("o", 1, 0), ("o", 2, 50)], [("o", 3, 60), ("p", 4, 10)]], "origin string, id bigint, ready bigint", lambda s: crawl_streams.paced(s, "origin", "ready", F.lit(200), "id"))
    assert sorted(r[1:] for r in got) == [(1, 0, 0), (2, 50, 200), (3, 60, 400), (4, 10, 10)]


@pytest.fixture()
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers["User-Agent"]))
            status, kind, body = {"/robots.txt": (200, "text/plain", "User-agent: *\nDisallow: /secret"), "/": (200, "text/html", "<a href=/b>b</a><a href=/secret>s</a><a href=/missing>m</a><a href=/busy>y</a><a href=/big>g</a><a href=/notes.txt>n</a>"),
                                  "/b": (200, "text/html; charset=utf-8", "é"), "/notes.txt": (200, "text/plain", "n"), "/big": (200, "text/html", "x" * 5000), "/busy": (503, "text/html", "")}.get(self.path, (404, "text/html", "no"))
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    web = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{web.server_port}", asked
    web.shutdown()


def test_live_crawl(spark, server):
    origin, asked = server
    config = CrawlConfig(start_url=origin, max_depth=1, min_interval_ms=0, retry_count=1, retry_base_delay_ms=1, max_response_bytes=4000)
    result = crawl(spark, config, live.answers(config, 0), live.robots_file(config))
    got = {r.canonicalUrl[len(origin) :]: (r.skipReason or r.errorKind or r.state, r.attempts) for r in result.pages.collect()}
    assert got == {"/": ("ok", 1), "/b": ("ok", 1), "/secret": ("robots", 0), "/missing": ("http-status", 1), "/busy": ("http-status", 2), "/big": ("too-large", 1), "/notes.txt": ("non-html", 1)}
    assert "/secret" not in [p for p, _ in asked] and {a for _, a in asked} == {"SkeinBot/1.0"}
    assert live.get("http://127.0.0.1:1/", config)["error_code"] == "ECONNREFUSED"


def test_command_line(spark, server):
    out, err, files = io.StringIO(), io.StringIO(), {}
    assert cli.run([server[0], "--depth", "0", "--min-interval", "0", "--format", "json", "--output", "r.json", "--trace"], out, err, write_file=files.__setitem__) == 0
    assert '"stopReason": "completed"' in files["r.json"] and "crawl\n  reserved" in out.getvalue() and "[trace] take" in err.getvalue()

    def broken(*_):
        raise OSError("disk full")

    out, err = io.StringIO(), io.StringIO()
    assert cli.run([server[0], "--depth", "0", "--output", "x"], out, err, write_file=broken) == 1 and out.getvalue() == "" and "disk full" in err.getvalue()


@pytest.mark.parametrize("argv", [[], ["ftp://x"], ["http://a", "http://b"], ["http://a", "--depth", "-1"], ["http://a", "--depth", "1.5"], ["http://a", "--max-pages", "0"], ["http://a", "--nope"],
                                  ["http://a", "--max-bytes", "3"], ["http://a", "--format", "xml"], ["http://a", "--details", "--format", "csv"], ["http://a", "--dep", "1"]])
def test_wrong_flags(argv):
    out, err = io.StringIO(), io.StringIO()
    assert cli.run(argv, out, err, crawl=None) == 2 and err.getvalue() and not out.getvalue()


def test_help():
    out = io.StringIO()
    assert cli.run(["-h"], out) == 0 and all(f in out.getvalue() for f, *_ in cli.NUMBERS + cli.SWITCHES)
