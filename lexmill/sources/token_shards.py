"""Binary token shards as a Spark data source.

A file has a header of 256 little-endian 32-bit integers (magic, version, number of tokens) and the
tokens as little-endian unsigned 16-bit integers. One file is one partition. Option strict (default
true): magic, version and size must be right; otherwise a file without header is read as bare tokens.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format.
MAGIC, VERSION, HEADER_INTS = 20240520, 1, 256
_BATCH = 1 << 20


def write_file(path: str, tokens: np.ndarray) -> None:
    """Written beside its place and moved there, so that a task that runs again leaves a whole file."""
    if len(tokens) and (tokens.min() < 0 or tokens.max() > 65_535):
        raise ValueError("token ids must fit 16 bits")
    header = np.zeros(HEADER_INTS, dtype="<i4")
    header[:3] = MAGIC, VERSION, len(tokens)
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as out:
        out.write(header.tobytes())
        out.write(tokens.astype("<u2").tobytes())
    os.replace(part, path)


def read_file(path: str, strict: bool = True) -> np.ndarray:
    """The tokens of a file, mapped rather than loaded."""
    size = os.path.getsize(path)
    header = np.fromfile(path, dtype="<i4", count=HEADER_INTS) if size >= HEADER_INTS * 4 else np.zeros(0, "<i4")
    if len(header) == HEADER_INTS and header[0] == MAGIC:
        n = int(header[2])
        if strict and (header[1] != VERSION or size != HEADER_INTS * 4 + 2 * n):
            raise ValueError(f"{path}: version or size is wrong")
        return np.memmap(path, dtype="<u2", mode="r", offset=HEADER_INTS * 4)[:n] if n else np.zeros(0, "<u2")
    if strict:
        raise ValueError(f"{path}: no token shard")
    if size % 2:
        raise ValueError(f"{path}: an odd number of bytes")
    return np.memmap(path, dtype="<u2", mode="r") if size else np.zeros(0, "<u2")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.strict = options["path"].removeprefix("file:").replace("//", "/"), options.get("strict", "true").lower() == "true"

    def partitions(self):
        return [_File(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder)) if f.endswith(".bin")]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        name, tokens = os.path.basename(partition.path)[:-4], read_file(partition.path, self.strict)
        for at in range(0, len(tokens), _BATCH):
            part = tokens[at : at + _BATCH].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(["train" if "train" in name else "val"] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part)], ["shard", "split", "pos", "token_id"])


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "shard string, split string, pos bigint, token_id int"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenShards)


def read(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """shard, split, pos, token_id of all .bin files of a folder that all executors see."""
    return spark.read.format("token_shards").option("strict", str(strict).lower()).load(folder)


def write(tokens: DataFrame, folder: str) -> None:
    """One file per shard of tokens(shard, pos, token_id), in order of pos; each shard is written by one task."""
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, n = None, [], 0

        def close():
            nonlocal n
            if name is not None:
                write_file(os.path.join(folder, f"{name}.bin"), np.concatenate(held))
                n += 1

        for b in batches:
            shards, ids = np.array(b.column(0).to_pylist(), dtype=object), b.column(1).to_numpy()
            cuts = np.flatnonzero(shards[1:] != shards[:-1]) + 1 if len(shards) else []
            for part, idx in zip(np.split(ids, cuts), [0, *cuts]):
                if len(part):
                    if shards[idx] != name:
                        close()
                        name, held = shards[idx], []
                    held.append(part)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    ordered = tokens.repartition("shard").sortWithinPartitions("shard", "pos").select("shard", F.col("token_id").cast("int"))
    ordered.mapInArrow(run, "files bigint").agg(F.sum("files")).collect()
