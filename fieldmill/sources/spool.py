"""A durable buffer between clients and streams: sealed files of lines in a folder that all executors share.

Whatever takes records from the outside, a listener, a webhook or a poller, seals them here before it acknowledges them, and the stream is
Spark's own file stream over the folder. So a restart loses nothing that was acknowledged, offsets are files, and executors read
them side by side. A file is written under a hidden name and renamed when it is whole. Any Hadoop address will do.
"""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from .files import read_records, stream_records


class Spool:
    """Lines are sealed by size or age, or at once by `seal`."""

    def __init__(self, spark: SparkSession, folder: str, max_bytes: int = 8 << 20, max_age: float = 1.0):
        self.spark, self.folder, self.max_bytes, self.max_age = spark, folder.rstrip("/"), max_bytes, max_age
        self.lock, self.held, self.size, self.since = threading.Lock(), [], 0, 0.0
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self.path(self.folder))
        self.open = True
        threading.Thread(target=self._age, daemon=True).start()

    def put(self, lines: list[str]) -> None:
        """Lines that may wait for others."""
        with self.lock:
            if not self.held:
                self.since = time.monotonic()
            self.held += lines
            self.size += sum(map(len, lines))
            if self.size >= self.max_bytes:
                self._flush()

    def seal(self, lines: list[str]) -> None:
        """Lines that are durable when this returns."""
        with self.lock:
            self.held += lines
            self._flush()

    def close(self) -> None:
        self.open = False
        self.seal([])

    def _age(self) -> None:
        while self.open:
            time.sleep(self.max_age / 4)
            with self.lock:
                if self.held and time.monotonic() - self.since >= self.max_age:
                    self._flush()

    def _flush(self) -> None:
        if not self.held:
            return
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.ndjson"
        hidden = self.path(f"{self.folder}/.{name}")
        out = self.files.create(hidden, True)
        try:
            out.write(bytearray("".join(x.rstrip("\n") + "\n" for x in self.held).encode()))
        finally:
            out.close()
        if not self.files.rename(hidden, self.path(f"{self.folder}/{name}")):
            raise OSError(f"{self.folder}/{name} could not be sealed")
        self.held, self.size = [], 0

    def records(self, streaming: bool) -> DataFrame:
        """(raw) of what is sealed, now or as it comes."""
        return stream_records(self.spark, self.folder) if streaming else read_records(self.spark, self.folder)
