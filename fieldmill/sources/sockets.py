"""Records from clients that connect to a TCP port or a Unix socket: a streaming data source that listens.

Lines are taken until the client closes; an unterminated last line counts. The listener lives in the driver, so this is
for feeds of one host; larger feeds come through files or a message log.
"""

from __future__ import annotations

import os
import queue
import socket
import threading

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Listeners by address, shared by the readers of this process.
_LISTENERS: dict[str, "Listener"] = {}


class Listener:
    def __init__(self, address: str, limit: int = 1 << 16, read_size: int = 1 << 19):
        self.lines: queue.Queue[str] = queue.Queue(limit)  # full: clients wait
        self.read_size = max(read_size, 8192)
        if address.startswith("unix:"):
            path = address[5:]
            if os.path.exists(path):
                os.unlink(path)
            self.server = socket.socket(socket.AF_UNIX)
            self.server.bind(path)
        else:
            host, _, port = address.rpartition(":")
            self.server = socket.socket()
            self.server.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            self.server.bind((host or "0.0.0.0", int(port)))
        self.server.listen()
        self.address = self.server.getsockname()
        threading.Thread(target=self._accept, daemon=True).start()

    def _accept(self) -> None:
        while True:
            try:
                client, _ = self.server.accept()
            except OSError:
                return
            threading.Thread(target=self._serve, args=(client,), daemon=True).start()

    def _serve(self, client: socket.socket) -> None:
        held = b""
        with client:
            while data := client.recv(self.read_size):
                *whole, held = (held + data).split(b"\n")
                for line in whole:
                    self._put(line)
        self._put(held)

    def _put(self, line: bytes) -> None:
        text = line.decode("utf-8", "replace").rstrip("\r")
        if text.strip():
            self.lines.put(text)

    def drain(self, most: int) -> list[str]:
        out = []
        while len(out) < most:
            try:
                out.append(self.lines.get_nowait())
            except queue.Empty:
                break
        return out

    def close(self) -> None:
        self.server.close()


def listener(address: str) -> Listener:
    if address not in _LISTENERS:
        _LISTENERS[address] = Listener(address)
    return _LISTENERS[address]


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.listener = listener(options.get("address", "0.0.0.0:9000"))
        self.most = int(options.get("maxRecordsPerBatch", "10000"))
        self.kept: dict[int, list[str]] = {}

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        lines = self.listener.drain(self.most)
        if lines:
            self.kept[start["n"]] = lines
        return iter((x,) for x in lines), {"n": start["n"] + len(lines)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter((x,) for at, lines in sorted(self.kept.items()) if start["n"] <= at < end["n"] for x in lines)

    def commit(self, end: dict) -> None:
        self.kept = {at: lines for at, lines in self.kept.items() if at + len(lines) > end["n"]}


class LineListener(DataSource):
    """format("line_listener"), options address (host:port or unix:path) and maxRecordsPerBatch; one column raw."""

    @classmethod
    def name(cls) -> str:
        return "line_listener"

    def schema(self) -> str:
        return "raw string"

    def simpleStreamReader(self, schema):
        return _Reader(self.options)
