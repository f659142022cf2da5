"""Event tables on disk: folders that never change, and a manifest that says which of them count.

A write puts its rows into a new folder ``written=ID`` and then publishes the next
manifest, which names for every table and day shard the version that holds it.  Readers
take the newest manifest.  A writer that dies before it publishes leaves nothing but a
folder nobody looks at, and one that loses a race to publish starts over from the manifest that
won, with the rows it has already written.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# Folders are ``written=ID/table=NAME/shard=DAY``: keys that no event table has as a column.
_MANIFESTS = "_manifests"
_ALREADY_THERE = "FileAlreadyExistsException"


@dataclass(frozen=True)
class Entry:
    """Where one shard of a table lies; ``shard`` is None for a table written as a whole.

    ``version`` is None if the shard has no rows of this table.  ``source`` tells
    what the shard was made from, if the writer said so.
    """

    table: str
    shard: str | None
    version: str | None
    source: str | None = None


Entries = Mapping[tuple[str, str | None], Entry]


class Store:
    """One root folder with its manifests."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._settings = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._settings)

    def _path(self, below: str):
        return self._hadoop.Path(f"{self.root}/{below}".rstrip("/"))

    def _names(self, below: str) -> list[str]:
        found = self._files.globStatus(self._path(below)) or []
        return [status.getPath().getName() for status in found]

    def new_version(self) -> str:
        return f"v-{uuid4().hex}"

    def folder(self, entry: Entry) -> str:
        shard = "" if entry.shard is None else f"/shard={entry.shard}"
        return f"{self.root}/written={entry.version}/table={entry.table}{shard}"

    def numbers(self) -> list[int]:
        """The manifests there are, oldest first."""
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{_MANIFESTS}/*.json"))

    def entries(self, number: int) -> dict[tuple[str, str | None], Entry]:
        stream = self._files.open(self._path(f"{_MANIFESTS}/{number:010d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = [Entry(**json.loads(line)) for line in text.splitlines()]
        return {(e.table, e.shard): e for e in found}

    def latest(self) -> tuple[int, dict[tuple[str, str | None], Entry]]:
        """Number and entries of the newest manifest; 0 and nothing before the first one."""
        numbers = self.numbers()
        return (numbers[-1], self.entries(numbers[-1])) if numbers else (0, {})

    def publish(self, number: int, entries: Entries) -> bool:
        """Make a manifest the newest one; False if another writer has taken its number.

        It is written beside its place and renamed, so that no reader sees half of it.
        """
        lines = "\n".join(json.dumps(asdict(e)) for _, e in sorted(entries.items(), key=repr))
        beside = self._path(f"{_MANIFESTS}/.{uuid4().hex}.tmp")
        out = self._files.create(beside, False)
        try:
            out.write(lines.encode())
        finally:
            out.close()
        gateway = self.spark.sparkContext._gateway
        rename = getattr(self._hadoop, "Options$Rename")
        options = gateway.new_array(rename, 1)
        options[0] = rename.NONE  # never over a manifest that is there
        place = self._files.makeQualified(self._path(f"{_MANIFESTS}/{number:010d}.json"))
        beside = self._files.makeQualified(beside)
        try:
            self._hadoop.FileContext.getFileContext(place.toUri(), self._settings).rename(beside, place, options)
        except Py4JJavaError as error:
            self._files.delete(beside, False)
            if _ALREADY_THERE in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def commit(self, change: Callable[[Entries], Entries]) -> None:
        """Publish what ``change`` makes of the newest entries, again if another writer was faster."""
        while True:
            number, entries = self.latest()
            if self.publish(number + 1, change(entries)):
                return

    def shards_in(self, version: str, table: str) -> list[str]:
        """The day shards that a version holds of a table."""
        names = self._names(f"written={version}/table={table}/shard=*")
        return [n.partition("=")[2] for n in names]

    def read(self, table: str, schema: str) -> DataFrame | None:
        """A table as the newest manifest has it; None if it names no such table."""
        _, entries = self.latest()
        own = [e for e in entries.values() if e.table == table]
        if not own:
            return None
        folders = sorted(self.folder(e) for e in own if e.version is not None)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*folders)

    def expire(self, keep: int = 1, hours: float = 24) -> None:
        """Remove all but the newest manifests and the versions that only older ones name.

        What is younger than ``hours`` stays: a reader may still hold it, and a writer may be
        about to publish it.
        """
        numbers = self.numbers()
        kept = numbers[-keep:]
        named = {e.version for n in kept for e in self.entries(n).values()}
        before = (datetime.now() - timedelta(hours=hours)).timestamp() * 1000
        for number in numbers[:-keep]:
            self._files.delete(self._path(f"{_MANIFESTS}/{number:010d}.json"), False)
        for status in self._files.globStatus(self._path("written=*")) or []:
            version = status.getPath().getName().partition("=")[2]
            if version not in named and status.getModificationTime() <= before:
                self._files.delete(status.getPath(), True)

    def fingerprints(self, below: str, more: str = "") -> dict[str, str]:
        """For each folder ``below/shard=...`` what its files are: names, sizes and times of change.

        The driver lists the files, as Spark itself does before a scan.
        """
        found: dict[str, list[tuple]] = {}
        path = self._hadoop.Path(below)
        files = path.getFileSystem(self._settings)
        for status in files.globStatus(self._hadoop.Path(f"{below}/shard=*")) or []:
            shard = status.getPath().getName().partition("=")[2]
            inside = files.listFiles(status.getPath(), True)
            own = found.setdefault(shard, [])
            while inside.hasNext():
                file = inside.next()
                if not file.getPath().getName().startswith(("_", ".")):
                    own.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
        return {
            shard: hashlib.sha256(repr((sorted(own), more)).encode()).hexdigest() for shard, own in found.items()
        }


def replaced(
    entries: Entries, tables: Iterable[str], shards: Callable[[str], bool], fresh: Iterable[Entry]
) -> dict[tuple[str, str | None], Entry]:
    """Entries in which the chosen shards of some tables are the fresh ones and no others."""
    names = set(tables)
    kept = {k: e for k, e in entries.items() if e.table not in names or e.shard is not None and not shards(e.shard)}
    return {**kept, **{(e.table, e.shard): e for e in fresh}}


def refuse_other_layout(entries: Entries, tables: Iterable[str], by_shard: bool) -> None:
    """A table is stored either as a whole or by shard; rows of one kind can't replace the other."""
    names = set(tables)
    for e in entries.values():
        if e.table in names and (e.shard is not None) != by_shard:
            stored = "as a whole" if by_shard else "by shard"
            raise ValueError(f"{e.table} is stored {stored} and can't be written otherwise; use another root")
