"""What the text operators share: table access, the shared folder, the train / held-out fold."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without the setting gets a new local folder; a cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
            current = spark.sparkContext.getCheckpointDir()
        base = current
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder inside the shared one, as a URI with its scheme, for tasks that write files themselves.

    Hadoop says which file system a path without a scheme means, so that tasks don't take it for one of their own machine.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(new_path(spark, name))
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    root = system.makeQualified(path).toString()
    opened(root)  # a file system that tasks can't open is an error here, before any work
    system.mkdirs(path)
    return root


def opened(root: str) -> tuple:
    """(file system, path) of a URI as pyarrow has them."""
    from pyarrow import fs

    scheme, colon, rest = root.partition(":")
    if not colon or scheme == "file" and not rest.startswith("/"):
        raise ValueError(f"{root} doesn't say which file system it is on")
    return fs.FileSystem.from_uri("s3:" + rest if scheme in ("s3a", "s3n") else root)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column | str, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % parts


def n_words(text: Column | str) -> Column:
    """Number of words, 0 for null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def recalled(new: Iterable[bytes], known: dict[bytes, bytes], before: dict[bytes, bytes]) -> list[bytes]:
    """Takes those of ``new`` that ``before`` knows over into ``known``, and returns the others."""
    if not before:
        return list(new)
    new = list(new)
    known.update([(x, before[x]) for x in filter(before.__contains__, new)])
    return list(filterfalse(known.__contains__, new))


def joined_ids(lists: pa.Array, ids_of: Callable[[list[bytes]], list[bytes]], kind: np.dtype) -> Iterator[bytes]:
    """For each list of units their ids, one after the other; none for a null list. ``ids_of`` gets the different units of all lists, each of them once."""
    coded = lists.flatten().dictionary_encode()
    found = ids_of(coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
    held = np.frombuffer(b"".join(found), kind)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) // kind.itemsize
    at = coded.indices.to_numpy()
    n = lengths[at]
    ends = np.cumsum(n)
    ids = held[np.repeat((np.cumsum(lengths) - lengths)[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    upto = np.concatenate(([0], ends))[np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), dtype=np.int64)]
    start = 0
    for end in upto.tolist():
        yield ids[start:end].tobytes()
        start = end
