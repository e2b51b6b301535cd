"""Trees of files: walked level by level, read and written by executors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import EXCLUDED, LANGUAGES
from ..operators.community import numbered
from ..shared import cut

#: Folders that are passed over, and the endings of files that are read. A caller may name others.
SKIPPED, EXTENSIONS = frozenset(EXCLUDED), frozenset(LANGUAGES)
FOUND = "path string, folder boolean, size long, modified timestamp"


def _at(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


def walk(spark: SparkSession, root: str, skipped: frozenset[str] = SKIPPED, extensions: frozenset[str] = EXTENSIONS) -> DataFrame:
    """(place, path, size, modified) of the files below ``root``, paths relative to it.

    Folders of ``skipped`` names are not entered, files of other than ``extensions`` (in any case) are not told;
    hidden ones are. The order is that of a walk that takes each folder's entries by code unit. A level of
    folders is a job: the folders are dealt out and listed by executors.
    """

    def listed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for folder in part.column("path").to_pylist():
                files, top = _at(root)
                found = files.get_file_info(pafs.FileSelector(f"{top}/{folder}" if folder else top))
                rows = [(f"{folder}/{i.base_name}" if folder else i.base_name, i.type == pafs.FileType.Directory, i.size or 0, i.mtime) for i in found if i.type in (pafs.FileType.Directory, pafs.FileType.File) and i.base_name not in skipped]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")))], ["path", "folder", "size", "modified"])

    level = spark.createDataFrame([("",)], "path string")
    levels = []
    while True:
        levels.append(cut(level.repartition("path").mapInArrow(listed, FOUND)))
        level = levels[-1].where("folder").select("path")
        if level.isEmpty():
            break
    ending = F.lower(F.regexp_extract("path", r"[^/](\.[^./]*)$", 1))
    files = reduce(DataFrame.unionByName, levels).where("not folder").drop("folder").where(ending.isin(*extensions))
    order = F.transform(F.split("path", "/"), lambda x: F.encode(x, "UTF-16BE"))
    return numbered(files.withColumn("order", order), "order", "place").select("place", "path", "size", "modified")


def read(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path, ...) with their ``text``; what is no UTF-8 is replaced. A file is held whole."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, top = _at(root)
            for k in range(len(part)):  # one text at a time
                with at.open_input_stream(f"{top}/{part.column('path')[k].as_py()}") as stream:
                    text = stream.readall().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([*part.slice(k, 1).columns, pa.array([text])], [*part.schema.names, "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema), "text string"])
    return files.mapInArrow(run, schema)


def write(files: DataFrame, root: str) -> None:
    """A file for each row (path, text) below ``root``; null texts are empty files. A file is written aside and moved
    into place, so a task that is repeated leaves the same tree."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, top = _at(root)
            for path, text in zip(part.column("path").to_pylist(), part.column("text").to_pylist()):
                folder = f"{top}/{path}".rpartition("/")[0]
                at.create_dir(folder, recursive=True)
                aside = f"{top}/{path}.aside"
                with at.open_output_stream(aside) as stream:
                    stream.write((text or "").encode())
                at.move(aside, f"{top}/{path}")
            yield pa.RecordBatch.from_arrays([pa.array([len(part)])], ["n"])

    files.select("path", "text").mapInArrow(run, "n long").agg(F.sum("n")).collect()  # one number
