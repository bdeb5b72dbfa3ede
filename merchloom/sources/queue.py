"""Fetched pages as a stream: a growing queue of addresses, read by byte offsets, so that a restart reads nothing twice."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .fetch import PAGE, answer_row

#: Bytes that are looked through at once for the end of a line.
CHUNK = 1 << 16


def located(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and a path in it: of a URI that Arrow knows, else of a mounted folder."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def whole_lines(path: str) -> int:
    """Bytes up to the end of the last line that is whole; 0 where there is no file yet."""
    system, at = located(path)
    size = max(system.get_file_info(at).size or 0, 0)
    if not size:
        return 0
    with system.open_input_file(at) as f:
        while size:
            begin = max(0, size - CHUNK)
            last = f.read_at(size - begin, begin).rfind(b"\n")
            if last >= 0:
                return begin + last + 1
            size = begin
    return 0


def lines_between(path: str, begin: int, end: int, first: int) -> Iterator[str]:
    """The lines that start in [begin, end); first is where some line is known to start, and begin may lie inside one."""
    system, at = located(path)
    with system.open_input_file(at) as f:
        pos, rest = begin, b""
        skip = begin > first
        if skip:
            pos = begin - 1  # a line that starts at begin has its end of line before it
        while True:
            data = f.read_at(CHUNK, pos)
            if not data:
                break
            pos += len(data)
            rest += data
            while (cut := rest.find(b"\n")) >= 0:
                start = pos - len(rest)
                line, rest = rest[:cut], rest[cut + 1 :]
                if skip:
                    skip = False
                    continue
                if start >= end:
                    return
                if text := line.decode("utf-8", "replace").strip():
                    yield text


class QueuePart(InputPartition):
    def __init__(self, begin: int, end: int, first: int) -> None:
        self.begin, self.end, self.first = begin, end, first


class QueueSource(DataSource):
    """spark.readStream.format("page_queue"): rows of PAGE for the addresses in a file that grows, one a line.

    Options: path of the file in storage that all executors see; fetcher, a function named "module:name"; partitions, the
    tasks of a micro-batch at most. A line counts once it is ended.
    """

    @classmethod
    def name(cls) -> str:
        return "page_queue"

    def schema(self) -> str:
        return PAGE

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return QueueReader(self.options)


class QueueReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.fetcher, self.parts = options["path"], options["fetcher"], int(options.get("partitions", "8"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"byte": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"byte": whole_lines(self.path)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["byte"], end["byte"]
        step = max(1, -(-(b - a) // self.parts))
        return [QueuePart(at, min(b, at + step), a) for at in range(a, b, step)]

    def read(self, partition: QueuePart) -> Iterator[tuple]:
        module, _, name = self.fetcher.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for url in lines_between(self.path, partition.begin, partition.end, partition.first):
            yield answer_row(url, fetch)

    def commit(self, end: dict) -> None:
        """Nothing to do: the queue is only appended to, and offsets are in the checkpoint."""


def page_stream(spark: SparkSession, path: str, fetcher: str, partitions: int = 8) -> DataFrame:
    """The pages of a growing queue as a stream."""
    spark.dataSource.register(QueueSource)
    return spark.readStream.format("page_queue").option("path", path).option("fetcher", fetcher).option("partitions", str(partitions)).load()
