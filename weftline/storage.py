"""The four envelope tables, their ids, and storage: a catalogue of Parquet folders replaced atomically.

Spark's files don't change. A change to a table is read, transform, write beside, then a swap of the pointer file
that names the current version, so readers see the old or the new table and a lost job leaves the old one.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "source_documents": "id string, source string, content string, content_type string, meta string",
    "json_schemas": "id string, content string, is_synthetic boolean, parent_schema_id string, meta string",
    "chunks": "id string, content string, content_type string, is_synthetic boolean, parent_document_id string, parent_chunk_id string, matches_parent_chunk boolean, schema_id string, meta string",
    "schema_conversions": "id string, input_chunk_id string, schema_id string, output_chunk_id string, group_id bigint, meta string",
}

_OWN: dict[str, str] = {}
#: Folders and files that this process made in the shared folder and has not yet removed, in order.
_MADE: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Where the setting is unset a folder of this
    machine will do for a local master only; anywhere else that is an error."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed by discard, at the end of a scratch, or with the process."""
    path = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    _MADE[path] = None
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _remove(path: str) -> None:
    files, at = fs.FileSystem.from_uri(path)
    kind = files.get_file_info(at).type
    if kind == fs.FileType.Directory:
        files.delete_dir(at)
    elif kind == fs.FileType.File:
        files.delete_file(at)
    _MADE.pop(path, None)


def discard(*frames: DataFrame) -> None:
    """Remove what materialise wrote for frames that nothing will read again."""
    for df in frames:
        _remove(df.written_at)


@contextmanager
def scratch() -> Iterator[None]:
    """What is written to the shared folder within is removed at the end, so a result must be written elsewhere before."""
    before = set(_MADE)
    try:
        yield
    finally:
        for path in [p for p in _MADE if p not in before]:
            _remove(path)


@atexit.register
def _remove_all() -> None:
    for path in list(_MADE):
        try:
            _remove(path)
        except OSError:  # the store is gone or unreachable as the process ends
            return


def new_id(*parts: Column | str) -> Column:
    """An id from what a row is made of: alike in every run and known before the row is written."""
    cols = [F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("\u0000")) for p in parts]
    return F.sha2(F.concat_ws("\u0001", *cols), 256).substr(1, 36)


def meta(**members: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in members.items()]))


class Store:
    """Envelope tables under a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self, name: str) -> tuple[fs.FileSystem, str]:
        files, path = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        return files, f"{path}/{name}/CURRENT"

    def create(self) -> None:
        """Empty tables where there are none."""
        for name, schema in SCHEMAS.items():
            if self.version(name) is None:
                self.replace(name, self.spark.createDataFrame([], schema))

    def version(self, name: str) -> str | None:
        files, path = self._pointer(name)
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(path) as f:
            return json.loads(f.read())["version"]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/{self.version(name)}")

    def replace(self, name: str, df: DataFrame) -> None:
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/{name}/{version}")
        files, path = self._pointer(name)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(f"{path}-{version}") as f:
            f.write(json.dumps({"version": version}).encode())
        files.move(f"{path}-{version}", path)

    def append(self, name: str, rows: DataFrame) -> None:
        self.replace(name, self.read(name).unionByName(rows))

    def vacuum(self, name: str, files_out: int | None = None) -> None:
        """Rewrite a table in fewer files and remove the versions that aren't current."""
        df = self.read(name)
        self.replace(name, df.coalesce(files_out) if files_out else df)
        files, path = self._pointer(name)
        keep = self.version(name)
        for info in files.get_file_info(fs.FileSelector(path.rpartition("/")[0])):
            if info.type == fs.FileType.Directory and info.base_name != keep:
                files.delete_dir(info.path)

    def scope(self, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], preview: bool = False) -> dict[str, DataFrame]:
        """Run a change over all tables; with preview nothing is written and the results are only given back."""
        tables = {n: self.read(n) for n in SCHEMAS}
        out = change(tables)
        if not preview:
            for name, df in out.items():
                self.replace(name, df)
        return out

    def sql(self, text: str) -> DataFrame:
        """A SELECT over the tables."""
        for name in SCHEMAS:
            self.read(name).createOrReplaceTempView(name)
        return self.spark.sql(text)
