"""What the operators of this subpackage have in common: tables, the shared folder, packed arrays.

Executors share only the folder in ``spark.checkpoint.dir`` with each other and the driver, so every
intermediate table and every model file goes there. Files are written under a name of their own and
then moved into place, so a task that runs again leaves a whole file.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names, with the scheme of its file system, so that tasks and Spark mean the same place.

    One of our own only where none is set and all tasks run in this machine (tests).
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("riskloom.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("riskloom.shared.dir", found)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here, replicas are the store's."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` gave and that nothing reads any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)


def shards(spark: SparkSession) -> int:
    """Shards of a distributed model: as many as the session shuffles into."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shards_for(docs: DataFrame, size: int, column: str = "text") -> int:
    """Shards of a model whose parts grow with the texts: enough that each has about ``size`` bytes of text or less."""
    total = docs.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0
    return max(shards(docs.sparkSession), -(-total // size))


def by_shard(rows: DataFrame, n: int, make, schema: str) -> DataFrame:
    """What ``make(shard, batches)`` yields for each shard of ``rows(shard int, ...)``: a task to a shard, its rows as a stream."""

    def task(batches):
        for b in batches:
            if b.num_rows:
                yield from make(b.column("shard")[0].as_py(), chain([b], batches))

    return rows.repartitionById(n, F.col("shard")).mapInArrow(task, schema)


def words(column):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column, null as no words."""
    return F.filter(F.split(F.coalesce(column, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


# -- files in the shared folder, from inside tasks -----------------------------------------------


def _filesystem(path: str):
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes) -> None:
    fs, at = _filesystem(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, at)


def read_file(path: str) -> bytes:
    fs, at = _filesystem(path)
    with fs.open_input_file(at) as f:
        return f.read()


_maps: dict[str, dict[str, np.ndarray]] = {}
#: Bytes of files held whole by a Python worker where the store is not mounted, before it lets them go.
HELD = 256 << 20
_held = [0]


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a JSON header of fixed size, then each array at a multiple of 8 bytes."""
    at, parts, head = 0, [], {}
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = [a.dtype.str, at, len(a)]
        raw += b"\0" * (-len(raw) % 8)
        parts.append(raw)
        at += len(raw)
    header = json.dumps(head).encode()
    header += b" " * (-(len(header) + 8) % 8)
    write_file(path, len(header).to_bytes(8, "little") + header + b"".join(parts))


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped where the store is a mounted folder; once per Python worker."""
    if path not in _maps:
        fs, at = _filesystem(path)
        local = isinstance(fs, pafs.LocalFileSystem)
        if len(_maps) > 4096 or (not local and _held[0] > HELD):
            _maps.clear()
            _held[0] = 0
        raw = np.memmap(at, np.uint8, "r") if local else np.frombuffer(read_file(path), np.uint8)
        _held[0] += 0 if local else len(raw)
        size = int(raw[:8].view(np.uint64)[0])
        head = json.loads(raw[8 : 8 + size].tobytes())
        start = 8 + size
        _maps[path] = {k: raw[start + o : start + o + n * np.dtype(t).itemsize].view(t) for k, (t, o, n) in head.items()}
    return _maps[path]


# -- packed arrays in rows ------------------------------------------------------------------------


def pack(a: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers as byte planes under Zstandard; ascending ones as differences."""
    a = np.ascontiguousarray(a, np.uint64)
    if ascending and len(a):
        a = np.diff(a, prepend=np.uint64(0))
    return len(a).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes, ascending: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=max(1, n * 8)), np.uint8)
    a = np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view(np.uint64) if n else np.zeros(0, np.uint64)
    return np.cumsum(a, dtype=np.uint64) if ascending else a


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard of each well-mixed 64-bit key, by its upper half: ranges of keys in order."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def mix(keys: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal keys stay equal, near ones part."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(batches, rows: int = 256):
    """Batches of few rows: what a task makes of a text is larger than the text."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def sheltered(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``docs`` with its columns but ``keep`` under names that nothing here uses; ``toDF(*docs.columns)`` gives them back."""
    return docs.toDF(*(c if c in keep else f"column_{i}" for i, c in enumerate(docs.columns)))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def starts_of(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
