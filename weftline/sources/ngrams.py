"""A source for n-gram indexes: a Python data source with a partition for each range of ranks of a shard. The client is
pluggable: the option `client` names a factory as module:function, which gets the options. The one here reads a folder
of JSON lines on any file system, so that it works without a network."""

from __future__ import annotations

import importlib
import io
import itertools
import json
import random
import re
import sys
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "doc_id string, shard int, rank bigint, spans array<string>, meta string"


class RateLimited(Exception):
    def __init__(self, after: float | None = None) -> None:
        super().__init__("rate limited")
        self.after = after


def with_retries(call: Callable[[], Any], tries: int = 5, base: float = 0.5, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> Any:
    """Call until it works; waits grow with the square of the try, with jitter, or are as long as the server says."""
    rng = rng or random.Random(0)
    for t in range(1, tries + 1):
        try:
            return call()
        except (RateLimited, OSError) as e:
            if t == tries:
                raise
            sleep(e.after if isinstance(e, RateLimited) and e.after is not None else base * t * t * (1 + rng.random()))
    return None


class Client(Protocol):
    """What an index must tell: where hits may lie, as (shard, first rank, end), and the documents of such a range that
    hold the query, with their ranks. segments is asked on the driver, hits in tasks."""

    def segments(self, query: str) -> list[tuple[int, int, int]]: ...

    def hits(self, query: str, shard: int, first: int, end: int) -> Iterator[tuple[int, dict[str, Any]]]: ...


class FolderClient:
    """shard-<n>.jsonl files with {doc_id, spans, meta} rows. The driver lists the files; each task reads its own once,
    line by line. Without an index of where hits lie, a segment is a whole shard."""

    def __init__(self, options: dict[str, str]) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(options["folder"])

    def segments(self, query: str) -> list[tuple[int, int, int]]:
        names = [f.base_name for f in self.store.get_file_info(fs.FileSelector(self.folder))]
        shards = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"shard-(\d+)\.jsonl", n)))
        return [(s, 0, sys.maxsize) for s in shards]

    def hits(self, query: str, shard: int, first: int, end: int) -> Iterator[tuple[int, dict[str, Any]]]:
        with self.store.open_input_stream(f"{self.folder}/shard-{shard}.jsonl") as f, io.TextIOWrapper(f, encoding="utf-8") as lines:
            for rank, line in enumerate(itertools.islice(lines, first, end), first):
                if line.strip() and query in "\n".join((row := json.loads(line))["spans"]):
                    yield rank, row


def client_of(options: dict[str, str]) -> Client:
    module, _, name = options.get("client", "weftline.sources.ngrams:FolderClient").partition(":")
    return getattr(importlib.import_module(module), name)(options)


class Segment(InputPartition):
    def __init__(self, shard: int, first: int, end: int) -> None:
        self.shard, self.first, self.end = shard, first, end


class NgramReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[Segment]:
        return [Segment(*x) for x in with_retries(lambda: client_of(self.options).segments(self.options["query"]))] or [Segment(-1, 0, 0)]

    def read(self, partition: Segment) -> Iterator[tuple]:
        """A segment's hits. Where a client fails, it is asked again from after the last rank that it gave."""
        client, at, hits = client_of(self.options), partition.first, None

        def following() -> tuple[int, dict[str, Any]] | None:
            nonlocal hits
            try:
                hits = hits or client.hits(self.options["query"], partition.shard, at, partition.end)
                return next(hits, None)
            except (RateLimited, OSError):
                hits = None
                raise

        while at < partition.end and (found := with_retries(following)) is not None:
            rank, row = found
            at = rank + 1
            yield row["doc_id"], partition.shard, rank, row["spans"], json.dumps(row.get("meta", {}))


class NgramSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ngrams"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> NgramReader:
        return NgramReader(dict(self.options))


def fenced_chunks(hits: DataFrame, least: int = 100, most: int | None = None) -> DataFrame:
    """(doc_id, content): JSON blocks of hit documents, each document once, each at least `least` characters."""
    from weftline.operators.udfs import blocks

    once = hits.select("doc_id", F.array_join("spans", "\n").alias("text")).groupBy("doc_id").agg(F.min("text").alias("text"))
    out = once.select("doc_id", F.explode(blocks("text")).alias("content")).where(F.length("content") >= least).distinct()
    return out if most is None else out.orderBy("doc_id", "content").limit(most)
