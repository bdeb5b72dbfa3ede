"""One file from many tasks: parts are written in parallel and put together once, in order, when all of them are there."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .queue import located

#: Bytes that are copied at once when parts are put together.
COPY = 1 << 22


@dataclass
class Part(WriterCommitMessage):
    """A task's part: its place in the file, its path, and how many lines it has."""

    place: int
    path: str
    lines: int


class OneFile(DataSource):
    """df.write.format("one_file").mode("append").save(path): the first column's texts as lines, in the order of partitions.

    The path is in storage that the driver and all executors see, and must not exist yet, unless the mode is overwrite.
    Option line_end. A job that fails leaves neither the file nor parts.
    """

    @classmethod
    def name(cls) -> str:
        return "one_file"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return PartWriter(self.options, overwrite)


class PartWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.end = options["path"], options.get("line_end", "\n").encode()
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        system, at = located(self.path)
        if not overwrite and system.get_file_info(at).type.name != "NotFound":
            raise FileExistsError(f"{self.path} is there already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        system, folder = located(self.parts)
        system.create_dir(folder, recursive=True)
        name, lines = f"{folder}/{task.partitionId():08d}-{task.taskAttemptId()}", 0  # attempts never share a part
        with system.open_output_stream(name) as out:
            for batch in iterator:
                texts = batch.column(0).to_pylist()
                lines += len(texts)
                if texts:
                    out.write(self.end.join([(t or "").encode() for t in texts]) + self.end)
        return Part(task.partitionId(), name, lines)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at = located(self.path)
        whole = f"{at}.tmp-{self.parts[-32:]}"
        with system.open_output_stream(whole) as out:
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.place):
                with system.open_input_stream(part.path) as f:
                    while data := f.read(COPY):
                        out.write(data)
        system.move(whole, at)
        self._remove()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._remove()

    def _remove(self) -> None:
        system, folder = located(self.parts)
        if system.get_file_info(folder).type.name == "Directory":
            system.delete_dir(folder)


def write_lines(lines: DataFrame, path: str, line_end: str = "\n", overwrite: bool = False) -> None:
    """A frame with one text column, ordered, to one file."""
    lines.sparkSession.dataSource.register(OneFile)
    lines.write.format("one_file").option("line_end", line_end).mode("overwrite" if overwrite else "append").save(path)
