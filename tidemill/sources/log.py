"""Message logs: a folder of numbered segments, each published whole, and a streaming source that admits messages by count.

A segment is a folder <number>/stream_name=<name>/ of files with one JSON object, {"payload": ...}, per line. It is
written beside the log and renamed to the next number, which fails if another writer was first (and is then tried
again), so readers never see half a segment and none is ever published behind their position. The order of arrival is (segment, file, line), with the
files of a segment by stream as the reader names them, then by name; it is the column seq.

The source (format `tidemill_log`) has the options path, streams (with commas), most (messages per batch; all if blank), start
(latest or earliest) and group. A group's position is kept in <path>/_groups, and written before a batch is read, so a
query that starts again from its checkpoint goes on there; a new group starts at `start`. One query reads for a group at a time.
"""

from __future__ import annotations

import io
import json
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "stream_name string, payload string, seq struct<segment:long,file:int,line:long>"

# executors get this module's classes by value: they need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file or folder to a name that nobody has; False if it is taken."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(target).toUri(), spark._jsc.hadoopConfiguration())
    rule = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rule, 1)
    options[0] = rule.NONE
    try:
        files.rename(path(source), path(target), options)
    except Exception as e:  # of the JVM
        if "FileAlreadyExists" in str(e) or files.util().exists(path(target)):
            return False
        raise
    return True


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(f.getPath().getName()) for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def append(messages: DataFrame, folder: str, stream: str | Column) -> int | None:
    """Publish messages (payload, and columns of which `stream` is made) as the next segment, in one write; its number,
    or None if there are none."""
    spark, folder = messages.sparkSession, folder.rstrip("/")
    staged = f"{folder}/_staged/{uuid.uuid4().hex}"
    name = F.lit(stream) if isinstance(stream, str) else stream
    messages.select("payload", name.alias("stream_name")).write.partitionBy("stream_name").option("ignoreNullFields", "false").json(staged)
    at = spark._jvm.org.apache.hadoop.fs.Path(staged)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not any(str(f.getPath().getName()).startswith("stream_name=") for f in fs.listStatus(at)):
        fs.delete(at, True)
        return None
    number = max(_numbers(spark, folder), default=0) + 1
    while not rename_new(spark, staged, f"{folder}/{number:012d}"):
        number += 1
    return number


@dataclass
class Piece(InputPartition):
    """Lines of one file from a byte on, up to a byte if given."""

    path: str
    stream: str
    segment: int
    file: int
    line: int
    byte: int
    end: int | None


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.fs, self.root = pafs.FileSystem.from_uri(options["path"] if "://" in options["path"] or ":/" in options["path"] else f"file://{options['path']}")
        self.uri, self.streams = options["path"], [s for s in options["streams"].split(",") if s]
        self.most = int(options["most"]) if options.get("most") else None
        self.start, self.kept_at = options.get("start") or "latest", f"{self.root}/_groups/{options['group']}.json"
        self.state: dict[str, dict] = {}  # first, last: where the group began, and where it is

    def segments(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.base_name.isdigit())

    def files(self, segment: int) -> list[tuple[str, str]]:
        """(stream, path) of a segment's files, in the order of arrival."""
        out = []
        for s in self.streams:
            found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{segment:012d}/stream_name={s}", allow_not_found=True))
            out += [(s, f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name.startswith("part-") and f.size]
        return out

    def exists(self, segment: int) -> bool:
        return self.fs.get_file_info(f"{self.root}/{segment:012d}").type != pafs.FileType.NotFound

    def keep(self, state: dict) -> None:
        self.state = state
        self.fs.create_dir(f"{self.root}/_groups")
        with self.fs.open_output_stream(f"{self.kept_at}.new") as f:
            f.write(json.dumps(state).encode())
        self.fs.move(f"{self.kept_at}.new", self.kept_at)

    def known(self) -> dict[str, dict]:
        """What is kept of the group; a new one begins at its start, which is kept."""
        if not self.state:
            if self.fs.get_file_info(self.kept_at).is_file:
                with self.fs.open_input_stream(self.kept_at) as f:
                    self.state = json.loads(f.read())
            else:
                found = self.segments()
                first = 1 if not found else found[0] if self.start == "earliest" else found[-1] + 1
                at = {"segment": first, "file": 0, "byte": 0, "line": 0}
                self.keep({"first": at, "last": at})
        return self.state

    def initialOffset(self) -> dict:
        """Where the group began: a first batch that failed is asked for from here once more."""
        return self.known()["first"]

    def latestOffset(self) -> dict:
        """At most `most` messages after the group's position."""
        at, left = dict(self.known()["last"]), self.most
        while self.exists(at["segment"]) and (left is None or left > 0):
            files = self.files(at["segment"]) if left is not None else []
            while at["file"] < len(files) and left > 0:
                with io.BufferedReader(self.fs.open_input_file(files[at["file"]][1])) as f:
                    f.seek(at["byte"])
                    for _, text in zip(range(left), f, strict=False):
                        at["byte"], at["line"], left = at["byte"] + len(text), at["line"] + 1, left - 1
                    done = not f.read(1)
                if done:
                    at |= {"file": at["file"] + 1, "byte": 0, "line": 0}
            if at["file"] >= len(files):
                at = {"segment": at["segment"] + 1, "file": 0, "byte": 0, "line": 0}
        return at

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.keep({"first": self.known()["first"], "last": end})
        out = []
        for segment in range(start["segment"], end["segment"] + 1):
            for k, (stream, path) in enumerate(self.files(segment) if self.exists(segment) else []):
                first = (start["byte"], start["line"]) if (segment, k) == (start["segment"], start["file"]) else (0, 0)
                if (segment, k) < (start["segment"], start["file"]) or (segment, k) > (end["segment"], end["file"]):
                    continue
                last = end["byte"] if (segment, k) == (end["segment"], end["file"]) else None
                if last is None or last > first[0]:
                    out.append(Piece(path, stream, segment, k, first[1], first[0], last))
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        seq = pa.struct([("segment", pa.int64()), ("file", pa.int32()), ("line", pa.int64())])
        with io.BufferedReader(self.fs.open_input_file(partition.path)) as f:
            f.seek(partition.byte)
            line, payloads, size = partition.line, [], 0

            def batch() -> pa.RecordBatch:
                at = [{"segment": partition.segment, "file": partition.file, "line": line + k} for k in range(len(payloads))]
                return pa.RecordBatch.from_arrays([pa.array([partition.stream] * len(payloads)), pa.array(payloads, pa.string()), pa.array(at, seq)], ["stream_name", "payload", "seq"])

            while (partition.end is None or f.tell() < partition.end) and (text := f.readline()):
                payloads.append(json.loads(text).get("payload"))
                size += len(text)
                if len(payloads) >= 1000 or size > 4_000_000:
                    yield batch()
                    line, payloads, size = line + len(payloads), [], 0
            if payloads:
                yield batch()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "fs"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"fs": pafs.FileSystem.from_uri(state["uri"] if ":/" in state["uri"] else f"file://{state['uri']}")[0]}


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemill_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(dict(self.options))


def read_log(spark: SparkSession, folder: str, streams: Sequence[str], group: str, most: int | None, start: str = "latest") -> DataFrame:
    """Stream of messages: stream_name, payload, seq."""
    spark.dataSource.register(LogSource)
    options = {"path": folder.rstrip("/"), "streams": ",".join(streams), "group": group, "most": "" if most is None else str(most), "start": start}
    return spark.readStream.format("tidemill_log").options(**options).load()
