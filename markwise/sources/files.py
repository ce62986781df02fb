"""A transactional sink of single files, for DataFrames (image_id, content): all files of a job come into being, or none.

Tasks write to <folder>/_staging/<job>/<a name of their own>. When all have ended, the driver writes <job>.json beside, a list of what is staged and where it
goes, under another name first and then moved: that move is the commit. Then the files are moved into place, which makes no copies. A job that dies
before the commit leaves the old files alone; one that dies after it is finished by recover(), which every later write to the folder and export() call. If a
task fails, its job's staging goes.

Places are whatever pyarrow's file systems open: local paths that all machines have mounted, hdfs, s3 and others. Names that start with _ are hidden from
Spark's readers, so staged files are in no scan. Rows of one name: the last one that is moved stays.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "markwise_files"
STAGING = "_staging"
#: Files that the driver moves at a time; a move sends no contents.
MOVERS = 16


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    found, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return found, path.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """What a task has staged: (staged name, final name)."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, suffix: str, job: str) -> None:
        self.folder, self.suffix, self.job = folder, suffix, job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = opened(self.folder)
        own, done = f"{path}/{STAGING}/{self.job}/{uuid.uuid4().hex}", []
        store.create_dir(own)
        for batch in iterator:
            for name, content in zip(batch["image_id"].to_pylist(), batch["content"].to_pylist(), strict=True):
                if not name or "/" in name:
                    raise ValueError(f"{name!r} is no file name")
                staged = f"{own}/{len(done)}"
                with store.open_output_stream(staged) as out:
                    out.write(content or b"")
                done.append((staged, f"{path}/{name}{self.suffix}"))
        return Written(done)

    def commit(self, messages: list) -> None:
        store, path = opened(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        log = f"{path}/{STAGING}/{self.job}"
        with store.open_output_stream(f"{log}.tmp") as out:
            out.write(json.dumps(files).encode())
        store.move(f"{log}.tmp", f"{log}.json")
        publish(store, path, self.job)

    def abort(self, messages: list) -> None:
        store, path = opened(self.folder)
        if store.get_file_info(f"{path}/{STAGING}/{self.job}").type == pafs.FileType.Directory:
            store.delete_dir(f"{path}/{STAGING}/{self.job}")
        _tidy(store, path)


def publish(store: pafs.FileSystem, path: str, job: str) -> None:
    """Moves a committed job's files into place; what an earlier try has moved is passed over."""
    log = f"{path}/{STAGING}/{job}"
    with store.open_input_stream(f"{log}.json") as file:
        files = json.loads(file.read())

    def put(pair: list[str]) -> None:
        if store.get_file_info(pair[0]).type == pafs.FileType.File:
            store.move(*pair)

    with ThreadPoolExecutor(MOVERS) as movers:
        list(movers.map(put, files))
    if store.get_file_info(log).type == pafs.FileType.Directory:
        store.delete_dir(log)
    store.delete_file(f"{log}.json")
    _tidy(store, path)


def _tidy(store: pafs.FileSystem, path: str) -> None:
    """Takes the staging folder away if nothing is staged any more."""
    staging = f"{path}/{STAGING}"
    if not store.get_file_info(pafs.FileSelector(staging, allow_not_found=True)) and store.get_file_info(staging).type == pafs.FileType.Directory:
        store.delete_dir(staging)


def recover(folder: str) -> int:
    """Finishes the jobs that were committed in the folder but not published; returns how many. Not while another job writes there."""
    store, path = opened(folder)
    found = store.get_file_info(pafs.FileSelector(f"{path}/{STAGING}", allow_not_found=True))
    jobs = [f.base_name.removesuffix(".json") for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".json")]
    for job in jobs:
        publish(store, path, job)
    return len(jobs)


class FileSink(DataSource):
    """spark.dataSource.register(FileSink); df.write.format("markwise_files").option("suffix", ".png").mode("append").save(folder)"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are added or replaced one by one: use the mode append")
        if missing := {"image_id", "content"} - set(schema.names):
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        return FileWriter(self.options["path"], self.options.get("suffix", ""), uuid.uuid4().hex)


def export(files: DataFrame, folder: str, suffix: str = ".png") -> None:
    """Writes (image_id, content) as single files <image_id><suffix>, all or none of them."""
    recover(folder)
    files.sparkSession.dataSource.register(FileSink)
    files.select("image_id", "content").write.format(FORMAT).option("suffix", suffix).mode("append").save(folder)
