"""Tables that streams append to: a list of live parts, switched atomically and compacted.

Every micro-batch is one part, a folder of Parquet files. The newest file below `_live` names the
parts that make up the table; a reader opens those and lists nothing else. A new list is written
beside the old ones and renamed to the next number, which fails if that number is taken: then the
change is made again on the list that won. So an append and a compaction may run at the same time.

A batch counts as stored once a list names it, also when its part has since been merged, so a replay
stores nothing twice whatever happened to the files. Batches of a checkpoint come in order; table
and checkpoint belong together.

Tables that number their own batches (`next_batch`) have one writer at a time.

`FANOUT` neighbouring parts of one level become one of the next: a table of n batches has at most
about FANOUT parts for each power of FANOUT in n, and each row is rewritten once a level. Keyed tables
keep the newest row of each key when parts are merged and read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from idsignal.workspace import fresh_name

FANOUT = 16
KEEP_LISTS = 20
LISTS = "_live"


@dataclass(frozen=True)
class Part:
    """The rows of batches `first` to `last`, in one folder."""

    folder: str
    first: int
    last: int
    level: int = 0


class Folder:
    """The few file operations a list needs, on whatever file system Spark has for the path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = path.rstrip("/")
        self.system = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        place = self.path(name)
        return [s.getPath().getName() for s in self.system.listStatus(place)] if self.system.exists(place) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether a file of that name was made whole by this call; False if there is one already."""
        draft = self.path(f"{name}.{fresh_name('draft')}")
        stream = self.system.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.conf)
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self.system.makeQualified(draft), self.system.makeQualified(self.path(name)), options)
            return True
        except Exception as error:
            if "FileAlreadyExistsException" not in str(error):
                raise
            self.system.delete(draft, False)
            return False

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)


class StreamTable:
    """A table below `path`; with `key`, rows are versions of keys and the one of the newest batch counts.

    `schema` may be left out where a table that has batches is only read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None, key: list[str] | None = None, fanout: int = FANOUT,
                 newest_by: str = "batch_id", partition_by: list[str] | None = None):
        self.spark, self.schema, self.key, self.fanout = spark, schema, key, fanout
        self.newest_by, self.partition_by = newest_by, partition_by or []
        self.files = Folder(spark, path)

    def lists(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(LISTS) if n.endswith(".json"))

    def live(self) -> tuple[int, list[Part]]:
        """The newest list and its number; number 0 is the empty table."""
        while True:
            numbers = self.lists()
            if not numbers:
                return 0, []
            try:
                return numbers[-1], [Part(**p) for p in json.loads(self.files.read(f"{LISTS}/{numbers[-1]:012d}.json"))]
            except Exception as error:  # a much newer list may have taken its place meanwhile
                if "FileNotFoundException" not in str(error) or self.lists()[-1:] == numbers[-1:]:
                    raise

    def commit(self, number: int, parts: list[Part]) -> bool:
        """Whether `parts` became list `number` + 1."""
        made = self.files.create(f"{LISTS}/{number + 1:012d}.json", json.dumps([asdict(p) for p in parts]))
        if made:
            for old in self.lists()[:-KEEP_LISTS]:
                self.files.delete(f"{LISTS}/{old:012d}.json")
        return made

    def has(self, batch_id: int) -> bool:
        parts = self.live()[1]
        return bool(parts) and batch_id <= parts[-1].last

    def append(self, batch: DataFrame, batch_id: int, instead: bool = False) -> bool:
        """Store a batch unless it is stored already; whether it did. With `instead` it replaces all others."""
        if self.has(batch_id):
            return False
        folder = f"batch_id={batch_id}"
        # a batch that failed before its list was written left files that count for nothing
        self.write(batch.select(*self.schema.fieldNames()), folder, "overwrite")
        while True:
            number, parts = self.live()
            if parts and batch_id <= parts[-1].last:
                return False
            made = [Part(folder, parts[0].first if parts else batch_id, batch_id)] if instead else [*parts, Part(folder, batch_id, batch_id)]
            if self.commit(number, made):
                return True

    def next_batch(self) -> int:
        """A number for the next batch of a table that numbers its own."""
        parts = self.live()[1]
        return parts[-1].last + 1 if parts else 1

    def write(self, rows: DataFrame, folder: str, mode: str) -> None:
        spread = rows.hint("rebalance", *self.partition_by) if self.partition_by else rows
        spread.write.mode(mode).partitionBy(*self.partition_by).parquet(f"{self.files.root}/{folder}")

    def run(self, parts: list[Part]) -> list[Part]:
        """The first `fanout` neighbours of one level."""
        start = 0
        for i, part in enumerate(parts):
            start = start if part.level == parts[start].level else i
            if i - start + 1 == self.fanout:
                return parts[start:i + 1]
        return []

    def compact(self) -> int:
        """Merge runs of parts until there is none; how many merges. Readers of older lists are not disturbed."""
        merges = 0
        while run := self.run(self.live()[1]):
            folder = f"_merged/{run[0].first}-{run[-1].last}-{fresh_name('part')}"
            self.write(self.newest(self.open(run)), folder, "errorifexists")
            merged = Part(folder, run[0].first, run[-1].last, run[0].level + 1)
            while True:
                number, parts = self.live()
                if not set(run) <= set(parts):  # someone else merged them
                    break
                at = parts.index(run[0])
                if self.commit(number, [*parts[:at], merged, *parts[at + len(run):]]):
                    merges += 1
                    break
        return merges

    def open(self, parts: list[Part]) -> DataFrame:
        folders = [f"{self.files.root}/{p.folder}" for p in parts]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        if not self.partition_by:
            return reader.parquet(*folders)
        # each part has its own partition folders, so Spark reads them one by one: at most `fanout` a level
        return reduce(DataFrame.unionByName, [reader.parquet(folder) for folder in folders])

    def newest(self, rows: DataFrame) -> DataFrame:
        if not self.key:
            return rows
        others = [f.name for f in self.schema.fields if f.name not in self.key]
        latest = F.max_by(F.struct(*others), self.newest_by).alias("_row")
        return rows.groupBy(*self.key).agg(latest).select(*self.key, "_row.*").select(*self.schema.fieldNames())

    def read(self) -> DataFrame:
        return self.newest(self.open(self.live()[1]))

    def batch(self, batch_id: int) -> DataFrame | None:
        """The rows of one batch, None once it has been merged with others."""
        own = [p for p in self.live()[1] if p.first == p.last == batch_id and not p.level]
        return self.open(own) if own else None

    def unused(self) -> Iterator[str]:
        """Folders that none of the kept lists names."""
        named = {p["folder"] for n in self.lists() for p in json.loads(self.files.read(f"{LISTS}/{n:012d}.json"))}
        stored = self.live()[1]
        done = stored[-1].last if stored else -1
        for name in self.files.names(""):
            if name.startswith("batch_id=") and name not in named and int(name[9:]) <= done:
                yield name
        for name in self.files.names("_merged"):
            # a merge under way is newer than any list: leave what no later batch has sealed
            if f"_merged/{name}" not in named and int(name.split("-")[1]) < done - self.fanout:
                yield f"_merged/{name}"

    def expire(self) -> int:
        """Delete folders no kept list names; readers may use any of the last `KEEP_LISTS` lists."""
        gone = list(self.unused())
        for name in gone:
            self.files.delete(name)
        return len(gone)
