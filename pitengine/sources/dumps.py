"""Dumps of entities: a Spark data source over tar archives of JSON-lines members.

``spark.read.format("entity_dump").option("path", folder)``. The planner reads only the archives' member headers and cuts members into byte
ranges; a task takes neighbouring ranges of an archive (one if they are as large as ``TASK_BYTES``), seeks to each and yields the records that start
in it as Arrow batches, so a lost task reads its own ranges again and nothing else, and one huge member is read by many tasks. A record is a line; a range begins behind the first line
break at or before its start, as text splits do. Members that are one JSON array, and compressed archives (.tar.xz, .tar.gz), which can't be
entered in the middle, are one partition each, streamed.

Each record gives a raw row (archive, member, the byte it starts at, payload) with its typed fields; what is no JSON object or has no
id keeps its payload and a ``problem``. ``write_dump`` writes such archives from rows, one per task.
"""

from __future__ import annotations

import io
import json
import os
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, member string, at long, id string, name string, type string, begin string, end string, related array<string>, payload string, problem string"
ARROW_SCHEMA = pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}[kind]) for name, kind in (f.split() for f in SCHEMA.split(", "))])
RANGE_BYTES = 64 << 20
#: Bytes of ranges that are read by one task where they are smaller, and records of an Arrow batch.
TASK_BYTES, BATCH_RECORDS = 16 << 20, 10_000
#: Bytes of a member that ``write_dump`` starts a new one after.
MEMBER_BYTES = 64 << 20
COMPRESSED = (".tar.xz", ".tar.gz", ".tgz", ".tar.bz2")
#: Where a record names its fields.
FIELDS = {"id": "id", "name": "name", "type": "type", "begin": "begin-date", "end": "end-date"}


@dataclass
class Range:
    archive: str
    member: str
    #: First byte of the member in the archive, its size, and the range of it; start is None for a member that is read as one.
    offset: int
    size: int
    start: int | None
    end: int


@dataclass
class Ranges(InputPartition):
    """Neighbouring ranges of one archive, which a task reads."""

    ranges: list[Range]


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pa.fs.LocalFileSystem(), path)


def related_ids(record: dict, kind: str | None = None) -> list[str]:
    """Ids that a record's relations point at, each once, of the target kind asked for; in the dump's form or the web service's."""
    lists = [record.get("relations")] + [x.get("relations") for x in record.get("relation-list") or [] if isinstance(x, dict)]
    found: dict[str, None] = {}
    for relation in (r for some in lists if isinstance(some, list) for r in some if isinstance(r, dict)):
        target_kind = relation.get("target-type")
        target = relation.get(target_kind) if isinstance(target_kind, str) else None
        if isinstance(target, dict) and target.get("id") and kind in (None, target_kind):
            found[target["id"]] = None
    return list(found)


def typed(archive: str, member: str, at: int, payload: str) -> tuple:
    try:
        record = json.loads(payload)
    except ValueError:
        record, problem = {}, "BAD_JSON"
    else:
        problem = "NO_OBJECT" if not isinstance(record, dict) else None if record.get("id") else "NO_ID"
    record = record if isinstance(record, dict) else {}
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    return archive, member, at, *(text(record.get(f)) for f in FIELDS.values()), [*map(text, related_ids(record))], payload, problem


def lines_in(stream, offset: int, size: int, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(place, text) of the lines of a member that start in [start, end)."""
    stream.seek(offset + max(start - 1, 0))
    reader = io.BufferedReader(stream, min(1 << 20, max(1 << 13, end - start)))  # no more than the range itself
    at = max(start - 1, 0)
    if start:  # up to the break that ends the line before; none is lost if the range starts right behind one
        at += len(reader.readline(size - at))
    while at < end:
        line = reader.readline(size - at)
        if not line:
            return
        if line.strip():
            yield at, line.decode("utf-8", "replace").strip()
        at += len(line)


class DumpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path") or ""
        self.range_bytes = int(options.get("rangebytes") or options.get("rangeBytes") or RANGE_BYTES)

    def archives(self) -> list[str]:
        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == pa.fs.FileType.File:
            return [path]
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = store.get_file_info(pa.fs.FileSelector(path, recursive=True))
        return sorted(f.path for f in found if f.type == pa.fs.FileType.File and f.path.endswith((".tar", *COMPRESSED)))

    def partitions(self) -> list[Ranges]:
        tasks, size = [], 0
        for r in self.ranges():
            last = tasks[-1].ranges[-1] if tasks else None
            size += r.end - (r.start or 0)
            if last is None or size > TASK_BYTES or last.archive != r.archive or r.archive.endswith(COMPRESSED):
                tasks.append(Ranges([]))
                size = r.end - (r.start or 0)
            tasks[-1].ranges.append(r)
        return tasks or [Ranges([])]

    def ranges(self) -> list[Range]:
        store, _ = _store(self.path)
        out = []
        for archive in self.archives():
            if archive.endswith(COMPRESSED):
                out.append(Range(archive, "", 0, 0, None, 0))
                continue
            with store.open_input_file(archive) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                for m in (m for m in tar if m.isfile()):
                    f.seek(m.offset_data)
                    if f.read(64).lstrip().startswith(b"["):
                        out.append(Range(archive, m.name, m.offset_data, m.size, None, m.size))
                    else:
                        out += [Range(archive, m.name, m.offset_data, m.size, at, min(at + self.range_bytes, m.size)) for at in range(0, m.size, self.range_bytes)]
        return out

    def read(self, task: Ranges) -> Iterator[pa.RecordBatch]:
        rows = (row for part in task.ranges for row in self._records(part))
        while some := list(islice(rows, BATCH_RECORDS)):
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for f, v in zip(ARROW_SCHEMA, zip(*some))], schema=ARROW_SCHEMA)

    def _records(self, part: Range) -> Iterator[tuple]:
        store, _ = _store(self.path)
        name = os.path.basename(part.archive)
        if part.archive.endswith(COMPRESSED):
            with store.open_input_stream(part.archive, compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as tar:
                for m in (m for m in tar if m.isfile()):
                    yield from self._whole(name, m.name, tar.extractfile(m))
            return
        with store.open_input_file(part.archive) as f:
            if part.start is None:
                f.seek(part.offset)
                yield from self._whole(name, part.member, io.BytesIO(f.read(part.size)))
            else:
                for at, line in lines_in(f, part.offset, part.size, part.start, part.end):
                    yield typed(name, part.member, at, line)

    @staticmethod
    def _whole(archive: str, member: str, stream) -> Iterator[tuple]:
        """All records of a member: the elements of one array, or its lines."""
        reader = io.BufferedReader(stream)
        if reader.peek(64)[:64].lstrip().startswith(b"["):
            try:
                items = json.loads(reader.read())
            except ValueError:
                yield archive, member, 0, *[None] * len(FIELDS), [], None, "BAD_JSON"
                return
            for at, item in enumerate(items):
                yield typed(archive, member, at, json.dumps(item))
            return
        at = 0
        for line in reader:
            if line.strip():
                yield typed(archive, member, at, line.decode("utf-8", "replace").strip())
            at += len(line)


class DumpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "entity_dump"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DumpReader:
        return DumpReader(dict(self.options))


def read_dump(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(DumpSource)
    return spark.read.format("entity_dump").option("rangeBytes", range_bytes).load(path)


def write_dump(rows: DataFrame, folder: str, member_bytes: int = MEMBER_BYTES) -> DataFrame:
    """Writes rows (kind, payload) as one tar archive per task into a shared folder; (archive, members, records) of each.

    A member holds records of one kind and ends at member_bytes. A task that runs again replaces its own archive whole.
    """
    dealt = rows.select("kind", "payload").sortWithinPartitions("kind").withColumn("part", F.spark_partition_id())

    def run(batches):
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        tar = out = part = kind = None
        held, members, records = bytearray(), 0, 0

        def close_member():
            nonlocal held, members
            if held:
                header = tarfile.TarInfo(f"dump/{kind}-{members:05d}")
                header.size = len(held)
                tar.addfile(header, io.BytesIO(bytes(held)))
                held, members = bytearray(), members + 1

        for batch in batches:
            for number, own, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "payload"))):
                if tar is None:
                    part, target = number, f"{path.rstrip('/')}/part-{number:05d}.tar"
                    out = store.open_output_stream(target + ".new")
                    tar = tarfile.open(fileobj=out, mode="w|")
                if own != kind or len(held) >= member_bytes:
                    close_member()
                    kind = own
                held += payload.encode() + b"\n"
                records += 1
        if tar is not None:
            close_member()
            tar.close()
            out.close()
            store.move(target + ".new", target)
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}.tar"]), pa.array([members], pa.int32()), pa.array([records], pa.int64())], ["archive", "members", "records"])

    return dealt.mapInArrow(run, "archive string, members int, records long")
