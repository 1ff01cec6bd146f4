"""Mapping files of any size and any producer, read in splits.

A mapping file is one JSON object; ``mappings`` holds an object for each placeholder.  A
split is a range of bytes and owns the entries whose name begins in it.  It need not know
what comes before: ``"name": {`` with bare quotes cannot stand inside a string, where
quotes are escaped, nor reach from the end of one string to the start of the next, since a
name does not begin with a blank, a comma, a colon or a bracket.  So every split finds its
own entries, whatever the indentation (names of placeholders hold no escapes), and reads on behind its end as far as its last
entry goes.  No row is larger than an entry.

The files are opened by the tasks: a path that all executors share, or an address that
pyarrow's file systems know.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from veilframe.operators.entities import mapping_from_entries
from veilframe.sources.sinks import file_system

FORMAT = "mapping_json"
SPLIT_BYTES = 32 << 20
BATCH = 10_000

#: Bytes that are read at a time, and that an entry is first looked for in.
STEP, ENTRY = 1 << 20, 1 << 10
OFFSET_BITS = 40  # of the place in a file; the number of the file is above

NAME = re.compile(rb'"([^"\\,:\[\]{}\s][^"\\]*)"\s*:\s*\{')
#: A name that may go on behind what was read so far.
OPEN_NAME = re.compile(rb'"(?:[^"\\,:\[\]{}\s][^"\\]*)?("\s*(:\s*)?)?\Z')

SCHEMA = pa.schema(
    [("file", pa.string()), ("entry_no", pa.int64()), ("placeholder", pa.string()), ("canonical", pa.string()),
     ("variations", pa.list_(pa.string())), ("occurrences", pa.int64())]
)


@dataclass
class Split(InputPartition):
    path: str
    number: int
    begin: int
    end: int
    size: int


class Window:
    """Bytes of a file from ``begin`` on, read further as they are asked for."""

    def __init__(self, file: pa.NativeFile, begin: int, size: int):
        self.file, self.begin, self.size = file, begin, size
        self.data = bytearray()
        file.seek(begin)

    def reach(self, length: int) -> bool:
        """Read until ``length`` bytes are there; whether they are."""
        while len(self.data) < length and self.begin + len(self.data) < self.size:
            self.data += self.file.read(max(STEP, length - len(self.data)))
        return len(self.data) >= length

    def object_at(self, place: int) -> dict | None:
        """The JSON object that begins at a place, null for none."""
        length = ENTRY
        while True:
            whole = not self.reach(place + length)
            text = bytes(self.data[place : place + length]).decode("utf-8", "ignore")
            try:
                return json.JSONDecoder(strict=False).raw_decode(text)[0]
            except json.JSONDecodeError:
                if whole:
                    return None
            length *= 2


#: Objects that are no entries, but hold some or hold counts.
OUTER = (b"mappings", b"statistics")


def entries_of(window: Window, length: int) -> Iterator[tuple[int, str, dict]]:
    """Place, name and object of the entries whose name begins in the first ``length``
    bytes of the window."""
    place = 0
    while place < length:
        found = NAME.search(window.data, place)
        if not found:
            # A name at the very end of what is there may go on.
            part = OPEN_NAME.search(window.data, place)
            place = part.start() if part else len(window.data)
            if place >= length or not window.reach(len(window.data) + 1):
                return
            continue
        if found.start() >= length:
            return
        if found[1] in OUTER:
            place = found.end()
            continue
        value = window.object_at(found.end() - 1)
        if isinstance(value, dict) and "canonical" in value:
            yield window.begin + found.start(), found[1].decode("utf-8", "replace"), value
        place = found.end()


class MappingReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Split]:
        files, root = file_system(self.path)
        info = files.get_file_info(root)
        if info.type == pafs.FileType.Directory:
            inside = files.get_file_info(pafs.FileSelector(root))
            named = sorted((f for f in inside if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.path)
        elif info.is_file:
            named = [info]
        else:
            raise FileNotFoundError(self.path)
        return [
            Split(f.path, n, begin, min(begin + self.split_bytes, f.size), f.size)
            for n, f in enumerate(named)
            for begin in range(0, f.size, self.split_bytes)
        ] or [Split("", 0, 0, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split.begin == split.end:
            return
        files, _ = file_system(self.path)
        rows: list[dict] = []
        with files.open_input_file(split.path) as file:
            window = Window(file, split.begin, split.size)
            window.reach(min(STEP, split.end - split.begin))
            for place, name, value in entries_of(window, split.end - split.begin):
                forms = value.get("variations")
                rows.append(
                    {
                        "file": split.path,
                        "entry_no": split.number << OFFSET_BITS | place,
                        "placeholder": name,
                        "canonical": value["canonical"],
                        "variations": [value["canonical"]] if forms is None else forms,
                        "occurrences": 1 if value.get("occurrences") is None else value["occurrences"],
                    }
                )
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


class MappingJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, entry_no long, placeholder string, canonical string, variations array<string>, occurrences long"

    def reader(self, schema: StructType) -> MappingReader:
        return MappingReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_large_mapping(
    spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, per_file: bool = False
) -> DataFrame:
    """The entries of a mapping file; of a folder, those of its files put end to end, or
    ``per_file`` of one mapping each (``scope_id``).  Of entries of one name the last counts."""
    spark.dataSource.register(MappingJson)
    rows = spark.read.format(FORMAT).option("splitBytes", split_bytes).load(path)
    scope = ["scope_id"] if per_file else []
    entry = F.struct("canonical", "variations", "occurrences", "entry_no")
    last = rows.withColumnRenamed("file", "scope_id").groupBy(*scope, "placeholder").agg(
        F.max_by(entry, "entry_no").alias("e")
    )
    return mapping_from_entries(last.select(*scope, "placeholder", "e.*"), scope)
