"""A store of model replies on shared storage, written as they come in.

Replies are keyed by a hash of what was asked and lie in ``bucket=…`` folders as
Parquet files. A task writes what it got every ``FLUSH`` replies, but once a second if
they come faster, and whenever it ends, also by an error; a file is complete or not
there, as it is renamed when written. A task that is run again, by Spark or by the next
job, finds what its predecessors got.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

#: Replies that a task may hold unwritten; those of how many seconds, if they are more; and of those at most.
FLUSH, FLUSH_SECONDS, FLUSH_MOST = 20, 1.0, 10_000
SCHEMA = "key string, reply string, prompt_tokens bigint, completion_tokens bigint"
_ARROW = pa.schema([("key", pa.string()), ("reply", pa.string()), ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64())])


def reply_key(messages: list[dict[str, str]], *more: Any) -> str:
    """Hash of the messages, and of what else tells two calls apart."""
    return hashlib.sha256(json.dumps([[[m["role"], m["content"]] for m in messages], *map(str, more)]).encode()).hexdigest()


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """All stored replies, one of each key."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("ignoreMissingFiles", True).schema(SCHEMA)
    path = path if "://" in path else f"file://{path}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SCHEMA)
    return files.parquet(path).dropDuplicates(["key"])


class Replies:
    """The replies of one bucket, in a task: those that are stored and those to be written."""

    def __init__(self, path: str, bucket: str, flush: int = FLUSH):
        self.fs, root = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        self.folder, self.flush_every, self.fresh = f"{root}/bucket={bucket}", flush, []
        self.written = time.monotonic()
        self.known: dict[str, tuple[str, int, int]] = {}
        found = self.fs.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True))
        for name in (f.path for f in found if f.path.endswith(".parquet")):
            for row in pq.read_table(name, filesystem=self.fs, schema=_ARROW, partitioning=None).to_pylist():
                self.known[row["key"]] = (row["reply"], row["prompt_tokens"], row["completion_tokens"])

    def ask(self, key: str, call: Callable[[], tuple[str, int, int, str | None]]) -> tuple[str, int, int, str | None]:
        """The stored reply, or that of a call, which is stored unless it failed."""
        if key in self.known:
            return (*self.known[key], None)
        reply, asked, said, error = call()
        if error is None:
            self.known[key] = (reply, asked, said)
            self.fresh.append({"key": key, "reply": reply, "prompt_tokens": asked, "completion_tokens": said})
            n = len(self.fresh)
            if n >= self.flush_every and (n >= FLUSH_MOST or time.monotonic() - self.written >= FLUSH_SECONDS):
                self.write()
        return reply, asked, said, error

    def write(self) -> None:
        if self.fresh:
            name = uuid.uuid4().hex
            self.fs.create_dir(self.folder, recursive=True)
            pq.write_table(pa.Table.from_pylist(self.fresh, _ARROW), f"{self.folder}/_{name}.tmp", filesystem=self.fs)
            self.fs.move(f"{self.folder}/_{name}.tmp", f"{self.folder}/{name}.parquet")
            self.fresh, self.written = [], time.monotonic()


class Buckets:
    """The bucket that a task is at; buckets come one after the other."""

    def __init__(self, path: str, flush: int = FLUSH):
        self.path, self.flush, self.bucket, self.replies = path, flush, None, None

    def at(self, bucket: str) -> Replies:
        if bucket != self.bucket:
            self.close()
            self.bucket, self.replies = bucket, Replies(self.path, bucket, self.flush)
        return self.replies

    def close(self) -> None:
        if self.replies:
            self.replies.write()

    def __enter__(self) -> Buckets:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
