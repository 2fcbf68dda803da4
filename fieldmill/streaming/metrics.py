"""Counters and latencies of running queries, and the endpoint that shows them."""

from __future__ import annotations

import threading
from bisect import bisect_left
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql.streaming import StreamingQueryListener


class Metrics(StreamingQueryListener):
    """Adds up records, rates and lag of all queries, and the time of their batches as a histogram; `render` gives them as plain metric lines."""

    #: Upper ends of the histogram's buckets in seconds, each twice the one before.
    BUCKETS = tuple(50e-6 * 2**i for i in range(16))

    def __init__(self):
        self.totals: Counter = Counter()
        self.latest: dict[str, float] = {}
        self.buckets = [0] * (len(self.BUCKETS) + 1)
        self.seconds = 0.0
        self.server: ThreadingHTTPServer | None = None

    def onQueryStarted(self, event) -> None:
        self.totals["queries_started"] += 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.totals["batches"] += 1
        self.observe(((p.durationMs or {}).get("addBatch") or 0) / 1000)
        self.totals["records_in"] += p.numInputRows
        self.latest["records_per_second"] = p.processedRowsPerSecond or 0.0
        for s in p.sources:
            for name, value in (s.metrics or {}).items():
                try:
                    self.latest[f"source_{name}"] = float(value)
                except ValueError:
                    pass
        for name, row in (p.observedMetrics or {}).items():
            for field, value in row.asDict().items():
                if isinstance(value, int):
                    self.totals[f"{name}_{field}"] += value

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.totals["queries_ended"] += 1
        self.totals["queries_failed"] += event.exception is not None

    def observe(self, seconds: float) -> None:
        """One batch's time."""
        self.buckets[bisect_left(self.BUCKETS, seconds)] += 1
        self.seconds += seconds

    def _histogram(self) -> str:
        out, below = "", 0
        for end, n in zip((*self.BUCKETS, float("inf")), self.buckets):
            below += n
            out += f'fieldmill_batch_seconds_bucket{{le="{"+Inf" if end == float("inf") else f"{end:g}"}"}} {below}\n'
        return out + f"fieldmill_batch_seconds_sum {self.seconds:g}\nfieldmill_batch_seconds_count {below}\n"

    def serve(self, port: int = 0, host: str = "0.0.0.0") -> int:
        """Shows the metrics at /metrics; the port that it listens on."""
        render = self.render

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                body = render().encode() if self.path == "/metrics" else b""
                self.send_response(200 if body else 404)
                self.send_header("Content-Type", "text/plain; version=0.0.4")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self.server.server_address[1]

    def close(self) -> None:
        if self.server:
            self.server.shutdown()
            self.server.server_close()

    def render(self) -> str:
        return self._histogram() + "".join(f"fieldmill_{k} {v}\n" for k, v in sorted({**self.totals, **self.latest}.items()))
