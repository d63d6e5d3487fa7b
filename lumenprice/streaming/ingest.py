"""Continuous ingest of a folder of price files, each content once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenprice.sources.files import detect_format, magic

#: Extensions that are taken in, in any case; other files aren't read.
EXTENSIONS = ("pdf", "docx", "xlsx", "xls")
#: Files of a batch of the registry.
FILES = 1000
FILE = "path string, modificationTime timestamp, length long, content binary"
ENTRY = "path string, name string, file_format string, file_hash string, original string"


def supported(extensions: tuple[str, ...] = EXTENSIONS) -> str:
    """A glob of the file names with these extensions, in any case."""
    any_case = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    return "{" + ",".join(f"*.{any_case(e)}" for e in extensions) + "}"


def files_of(spark: SparkSession, folder: str, **options: Any) -> DataFrame:
    """path, name, file_format, content of the files that a stream of a folder finds."""
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema(FILE)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return reader.options(**options).load(folder).select("path", name.alias("name"), detect_format(name, magic(F.col("content"))).alias("file_format"), "content")


def ingest(spark: SparkSession, folder: str, checkpoint: str, process: Callable[[DataFrame], None], once: bool = True) -> StreamingQuery:
    """Gives every new file of a folder to process once, as batches (path, name, file_format, content).

    With once, what is there is taken and the query ends; a restart goes on after the last finished batch.
    """
    rows = files_of(spark, folder)
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: process(batch))
    return (writer.trigger(availableNow=True) if once else writer).start()


def registered(files: DataFrame) -> DataFrame:
    """path, name, file_format, file_hash of a stream of files, and original: null for the first file of a content, the first's path for the others.

    The registry is the stream's state: a path for each SHA-256, kept over restarts by the checkpoint. Contents don't go into it. Of
    equal files of one batch the first by path counts.
    """

    def tell(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("path")
        first = state.get[0] if state.exists else None
        if first is None:
            first = rows["path"].iloc[0]
            state.update((first,))
            own = [None, *[first] * (len(rows) - 1)]
        else:
            own = [first] * len(rows)
        yield rows.assign(original=own)[["path", "name", "file_format", "file_hash", "original"]]

    keyed = files.select("path", "name", "file_format", F.sha2("content", 256).alias("file_hash"))
    return keyed.groupBy("file_hash").applyInPandasWithState(tell, ENTRY, "path string", "append", GroupStateTimeout.NoTimeout)


def ingest_new(spark: SparkSession, folder: str, checkpoint: str, take: Callable[[DataFrame], None], skip: Callable[[DataFrame], None], once: bool = True) -> StreamingQuery:
    """Gives each new content of a folder to take once (path, name, file_format, file_hash, content) and files that repeat one to skip (without content, with original).

    Files of other extensions aren't listed. A batch has FILES files at most, and the contents of the new ones are read again by path.
    A batch that was cut off by a failure is given again, with the same files.
    """
    rows = registered(files_of(spark, folder, pathGlobFilter=supported(), maxFilesPerTrigger=FILES))

    def both(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"]) for r in batch.filter("original is null").select("path").collect()]  # FILES at most
            if paths:
                contents = spark.read.format("binaryFile").load(paths).select("path", "content")
                take(batch.filter("original is null").drop("original").join(contents, "path"))
            skip(batch.filter("original is not null"))
        finally:
            batch.unpersist()

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(both)
    return (writer.trigger(availableNow=True) if once else writer).start()
