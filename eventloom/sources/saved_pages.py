"""Saved pages as a data source: ``spark.read.format("saved_pages")`` and ``df.write.format("saved_pages")``.

Under ``path`` lie compressed JSON lines by host and a mark per finished write. A write's files count once its mark is there, an
aborted one removes them. A read has a partition per host, several for a host with many files. ``path`` may be any file
system that tasks and driver share. Call ``register(spark)`` once per session.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.window import Window

SCHEMA = "host string, url string, fetched_at timestamp, html string, error string"
#: Bytes of files that one task reads (a larger file is a partition by itself).
TASK_BYTES = 32 << 20
#: Open files of a writing task: beyond, the hosts so far are closed and go on in another file.
OPEN_HOSTS = 64


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(system, folder: str, deep: bool = False):
    from pyarrow import fs

    return [f for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=deep)) if f.type == fs.FileType.File]


@dataclass
class HostFiles(InputPartition):
    host: str
    names: tuple[str, ...]

    def __init__(self, host: str, names: tuple[str, ...]) -> None:
        self.host, self.names, self.value = host, names, host


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]
    pages: int
    failed: int


class PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        minutes = options.get("minutes")
        now = datetime.fromisoformat(options["now"]) if options.get("now") else datetime.now(timezone.utc)
        now = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
        self.since = now - timedelta(minutes=float(minutes)) if minutes else None

    def partitions(self):
        system, root = _files(self.path)
        done = {f.base_name for f in _listed(system, f"{root}/_written")}
        found: dict[str, list] = {}
        for f in _listed(system, f"{root}/pages", deep=True):
            if f.base_name.split(".")[0] in done:
                found.setdefault(f.path.rsplit("/", 2)[1].removeprefix("host="), []).append(f)
        parts = []
        for host, files in sorted(found.items()):
            names, size = [], 0
            for f in files:
                if names and size + f.size > TASK_BYTES:
                    parts.append(HostFiles(host, tuple(names)))
                    names, size = [], 0
                names.append(f.path)
                size += f.size
            parts.append(HostFiles(host, tuple(names)))
        return parts or [HostFiles("", ())]

    def read(self, partition):
        system, _ = _files(self.path)
        for name in partition.names:
            with system.open_input_stream(name, compression="gzip") as raw:
                for line in _lines(raw):
                    try:
                        page = json.loads(line)
                        at = datetime.fromisoformat(page["fetched_at"]) if page["fetched_at"] else None
                        row = (partition.host, page["url"], at, page["html"], None)
                    except (ValueError, KeyError, TypeError) as problem:  # a broken line is told, it does not end the read
                        yield (partition.host, None, None, None, f"{name}: {problem}"[:500])
                        continue
                    if self.since is None or (at is not None and at > self.since):
                        yield row


def _lines(raw, block: int = 1 << 20):
    rest = b""
    while chunk := raw.read(block):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


class PageWriter(DataSourceWriter):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.batch = options["path"], uuid.uuid4().hex
        missing = {"url", "fetched_at", "html"} - set(schema.names)
        if missing:
            raise ValueError(f"saved pages need columns {sorted(missing)}")

    def write(self, iterator):
        system, root = _files(self.path)
        task, names, pages, failed, open_ = uuid.uuid4().hex, [], 0, 0, {}

        def close() -> None:
            for out in open_.values():
                out.close()
            open_.clear()

        for row in iterator:
            try:
                host = urlsplit(row["url"]).hostname
                if not host:
                    raise ValueError("no host")
                at = row["fetched_at"]
                at = None if at is None else (at if at.tzinfo else at.astimezone()).astimezone(timezone.utc).isoformat()
                line = json.dumps({"url": row["url"], "fetched_at": at, "html": row["html"]}).encode()
            except (ValueError, TypeError, AttributeError):  # a page without an address cannot be found again
                failed += 1
                continue
            if host not in open_:
                if len(open_) >= OPEN_HOSTS:
                    close()
                system.create_dir(f"{root}/pages/host={host}", recursive=True)
                names.append(f"{root}/pages/host={host}/{self.batch}.{task}.{len(names)}")
                open_[host] = system.open_output_stream(names[-1], compression="gzip")
            open_[host].write(line + b"\n")
            pages += 1
        close()
        return Written(tuple(names), pages, failed)

    def commit(self, messages):
        """The mark tells how many pages were saved and how many rows had no usable address. Files of repeated tasks have no place in it."""
        system, root = _files(self.path)
        told = [m for m in messages if m]
        kept = {n for m in told for n in m.names}
        for f in _listed(system, f"{root}/pages", deep=True):
            if f.base_name.startswith(f"{self.batch}.") and f.path not in kept:
                system.delete_file(f.path)
        system.create_dir(f"{root}/_written", recursive=True)
        with system.open_output_stream(f"{root}/_written/{self.batch}") as out:
            out.write(json.dumps({"pages": sum(m.pages for m in told), "failed": sum(m.failed for m in told)}).encode())

    def abort(self, messages):
        system, root = _files(self.path)
        for f in _listed(system, f"{root}/pages", deep=True):
            if f.base_name.startswith(f"{self.batch}."):
                system.delete_file(f.path)


class SavedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return PageReader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("saved pages are only added to")
        return PageWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SavedPages)


def save(pages: DataFrame, path: str) -> None:
    """Add pages(url, fetched_at, html); rows without a usable address are counted in the write's mark and left out."""
    # a host's pages together, so that there are few files; a large host in several tasks
    by_host = pages.select("url", "fetched_at", "html", F.regexp_extract("url", "://([^/?#]*)", 1).alias("__host"))
    by_host.hint("rebalance", "__host").drop("__host").write.format("saved_pages").mode("append").option("path", path).save()


def latest(spark: SparkSession, path: str, now: datetime | None = None, minutes: float | None = None) -> DataFrame:
    """The last page of each address, if it is younger than ``minutes`` (all ages if None); broken lines are left out."""
    asked = spark.read.format("saved_pages").option("path", path)
    if minutes is not None:
        asked = asked.option("minutes", str(minutes))
    if now is not None:
        asked = asked.option("now", now.isoformat())
    by = Window.partitionBy("url").orderBy(F.desc("fetched_at"), F.desc("html"))
    return asked.load().filter("error IS NULL").withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n", "error")
