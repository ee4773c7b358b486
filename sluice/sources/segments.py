"""A data source of our own: a table of committed segments, read as a batch or as a stream.

Every write that commits adds one manifest, which names the files of its tasks.
Only what manifests name is read, so a write that fails leaves nothing to be seen,
and the number of manifests is a stream's offset: a batch is a run of them, which
gives the same rows however often it is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: a file's name, or none where it had no rows."""

    name: str | None
    rows: int


class Folder:
    """A segment table's folder, in any store that pyarrow reaches."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        self.fs, self.path = fs.FileSystem.from_uri(self.uri)

    def manifests(self) -> list[dict]:
        """All manifests by number."""
        found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/commits", allow_not_found=True))
        names = sorted(f.path for f in found if f.path.endswith(".json"))
        return [json.loads(self.fs.open_input_stream(n).readall()) for n in names]

    def count(self) -> int:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/commits", allow_not_found=True))
        return sum(f.path.endswith(".json") for f in found)

    def commit(self, files: list[str], replace: bool, schema: str) -> None:
        """Add a manifest: written beside the others, and then moved to its name, so that nobody reads half of it."""
        self.fs.create_dir(f"{self.path}/commits", recursive=True)
        number = self.count()
        to, part = f"{self.path}/commits/{number:012d}.json", f"{self.path}/commits/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps({"number": number, "replace": replace, "files": files, "schema": schema}).encode())
        if self.fs.get_file_info(to).type != fs.FileType.NotFound:
            self.fs.delete_file(part)
            raise RuntimeError(f"commit {number} of {self.uri} was made by another writer")
        self.fs.move(part, to)


class Segment(InputPartition):
    def __init__(self, uri: str, name: str):
        self.uri, self.name = uri, name


def read_segment(part: Segment | None) -> Iterator[pa.RecordBatch]:
    if part is None:  # a table without segments
        return
    folder = Folder(part.uri)
    with folder.fs.open_input_file(f"{folder.path}/data/{part.name}") as f:
        yield from pq.ParquetFile(f).iter_batches()


class SegmentReader(DataSourceReader):
    """What the table holds now: the files since the last manifest that replaced what was there."""

    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[Segment]:
        names: list[str] = []
        for m in Folder(self.uri).manifests():
            names = [*([] if m["replace"] else names), *m["files"]]
        return [Segment(self.uri, n) for n in names]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return read_segment(partition)


class SegmentStream(DataSourceStreamReader):
    """The table's commits in order; the offset is how many of them have been read."""

    def __init__(self, uri: str):
        self.uri = uri

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": Folder(self.uri).count()}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        made = Folder(self.uri).manifests()[start["commits"] : end["commits"]]
        if any(m["replace"] for m in made[0 if start["commits"] else 1 :]):
            raise RuntimeError("a commit has replaced what was streamed")
        return [Segment(self.uri, n) for m in made for n in m["files"]]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return read_segment(partition)

    def commit(self, end: dict) -> None:
        pass  # segments stay: other readers may still want them


class SegmentWriter(DataSourceArrowWriter):
    """Each task writes one file under a name of its own; the commit names the files of the tasks that count."""

    def __init__(self, uri: str, schema: StructType, overwrite: bool):
        self.uri, self.schema, self.overwrite = uri, schema.json(), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, name, rows, writer = Folder(self.uri), f"{uuid.uuid4().hex}.parquet", 0, None
        folder.fs.create_dir(f"{folder.path}/data", recursive=True)
        try:
            for b in iterator:
                writer = writer or pq.ParquetWriter(f"{folder.path}/data/{name}", b.schema, filesystem=folder.fs)
                writer.write_batch(b)
                rows += b.num_rows
        finally:
            if writer:
                writer.close()
        return Written(name if writer else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        Folder(self.uri).commit([m.name for m in messages if m and m.name], self.overwrite, self.schema)

    def abort(self, messages: list[Written | None]) -> None:
        """Delete what finished tasks have written; files of failed ones are in no manifest."""
        folder = Folder(self.uri)
        for m in messages:
            if m and m.name:
                folder.fs.delete_file(f"{folder.path}/data/{m.name}")


class SegmentSource(DataSource):
    """format("segments"): path, the folder's address."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> StructType:
        made = Folder(self.options["path"]).manifests()
        if not made:
            raise ValueError(f"nothing has been committed to {self.options['path']}")
        return StructType.fromJson(json.loads(made[-1]["schema"]))

    def reader(self, schema: StructType) -> SegmentReader:
        return SegmentReader(self.options["path"])

    def streamReader(self, schema: StructType) -> SegmentStream:
        return SegmentStream(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> SegmentWriter:
        return SegmentWriter(self.options["path"], schema, overwrite)


def append(df: DataFrame, uri: str, overwrite: bool = False) -> None:
    """Commit df as segments, one a partition that has rows."""
    df.sparkSession.dataSource.register(SegmentSource)
    df.write.format("segments").mode("overwrite" if overwrite else "append").save(uri)


def read(spark: SparkSession, uri: str) -> DataFrame:
    spark.dataSource.register(SegmentSource)
    return spark.read.format("segments").load(uri)


def stream(spark: SparkSession, uri: str) -> DataFrame:
    spark.dataSource.register(SegmentSource)
    return spark.readStream.format("segments").load(uri)
