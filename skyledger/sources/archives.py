"""A Python data source of CSV files in ZIP archives: one partition for each member, streamed from the store."""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from skyledger.sources.scratch import new_path, written

#: Bytes of CSV that a task parses at once.
BLOCK = 4 << 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Member(InputPartition):
    path: str
    name: str


class ZipReader(DataSourceReader):
    def __init__(self, paths: Sequence[str], suffix: str, columns: Sequence[str]) -> None:
        self.paths, self.suffix, self.columns = list(paths), suffix, list(columns)

    def partitions(self) -> list[Member]:
        """Members whose names end in the suffix; only the directories of the archives are read."""
        out = []
        for path in self.paths:
            store, place = _store(path)
            with store.open_input_file(place) as f, zipfile.ZipFile(f) as z:
                names = sorted(n for n in z.namelist() if n.lower().endswith(self.suffix) and not n.endswith("/"))
            if not names:
                raise ValueError(f"no {self.suffix} in {path}")
            out += [Member(path, n) for n in names]
        return out

    def read(self, member: Member) -> Iterator[pa.RecordBatch]:
        from pyarrow import csv

        store, place = _store(member.path)
        with store.open_input_file(place) as f, zipfile.ZipFile(f) as z, z.open(member.name) as data:
            head = data.readline().decode("utf-8-sig").rstrip("\r\n")
        names = csv.read_csv(pa.BufferReader(f"{head}\n".encode())).column_names if head.strip() else []
        if missing := [c for c in self.columns if c not in names]:
            raise KeyError(f"missing columns in {member.name}: {', '.join(missing)}")
        with store.open_input_file(place) as f, zipfile.ZipFile(f) as z, z.open(member.name) as data:
            options = csv.ConvertOptions(column_types=dict.fromkeys(self.columns, pa.string()), include_columns=self.columns, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=True)
            with csv.open_csv(pa.PythonFile(data, mode="r"), read_options=csv.ReadOptions(block_size=BLOCK, use_threads=False), parse_options=csv.ParseOptions(newlines_in_values=True), convert_options=options) as batches:
                yield from batches


class ZipCsv(DataSource):
    """``format("zip_csv")`` with options ``paths`` (a JSON list of archives), ``columns`` (a JSON list) and ``suffix``; every column is text, empty text null."""

    @classmethod
    def name(cls) -> str:
        return "zip_csv"

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in json.loads(self.options["columns"])])

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(json.loads(self.options["paths"]), self.options.get("suffix", ".csv"), json.loads(self.options["columns"]))


def read_members(spark: SparkSession, columns: Sequence[str], *paths: str, suffix: str = ".csv") -> DataFrame:
    """All members of the archives ``paths`` whose names end in ``suffix``, ``columns`` as text.

    An archive may be of any size: a task opens it in the store, seeks its own member and streams that in blocks.
    Members without one of the columns, and archives without members, raise; members without rows give none.
    """
    spark.dataSource.register(ZipCsv)
    return spark.read.format("zip_csv").options(paths=json.dumps(list(paths)), columns=json.dumps(list(columns)), suffix=suffix).load()


def write_archives(rows: DataFrame, path: str, archive: str, member: str) -> DataFrame:
    """(path, members) of one ZIP below ``path`` for each value of the column ``archive``, with a CSV for each value of ``member``.

    Tasks write their rows of each member to a compressed file of its own in the shared folder, as the rows come (a task has as many files
    open as it has members); then one task for each archive streams the files into its ZIP. No task holds an archive or a member.
    """
    names, place_of = [c for c in rows.columns if c not in (archive, member)], new_path(rows.sparkSession, "pieces")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import csv

        store, place = _store(place_of)
        store.create_dir(place, recursive=True)
        run, found = uuid.uuid4().hex, {}  # files of an attempt that fails are in no row
        for batch in batches:
            table, at = pa.Table.from_batches([batch]).sort_by([("__archive", "ascending"), ("__member", "ascending")]), 0
            for count, *key in zip(*(c.to_pylist() for c in table.group_by(["__archive", "__member"], use_threads=False).aggregate([([], "count_all")]).select(["count_all", "__archive", "__member"]).columns)):
                part, at = table.slice(at, count).select(names), at + count
                if (key := tuple(key)) not in found:
                    file = f"{place_of}/{run}-{len(found)}"
                    sink = store.open_output_stream(_store(file)[1], compression="zstd")
                    found[key] = file, sink, csv.CSVWriter(sink, part.schema, write_options=csv.WriteOptions(include_header=False))
                found[key][2].write_table(part)
        for _, sink, writer in found.values():
            writer.close()
            sink.close()
        keys = [pa.array([k[i] for k in found], types.field(i).type) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array([f for f, _, _ in found.values()], pa.string())], ["__archive", "__member", "file"])

    kinds = StructType([StructField("__archive", rows.schema[archive].dataType), StructField("__member", rows.schema[member].dataType), StructField("file", StringType())])
    types = to_arrow_schema(kinds)
    made = written(rows.select(F.col(archive).alias("__archive"), F.col(member).alias("__member"), *names).mapInArrow(pieces, kinds), "files")
    header = ",".join('"' + n.replace('"', '""') + '"' for n in names).encode() + b"\n"

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        store, place = _store(path)
        store.create_dir(place, recursive=True)
        files: dict = {}
        for r in table.to_pylist():
            files.setdefault(r["__member"], []).append(r["file"])
        with store.open_output_stream(f"{place}/{key[0].as_py()}.zip") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
            for value in sorted(files, key=lambda v: (v is None, v)):
                with z.open(f"{value}.csv", "w", force_zip64=True) as out:
                    out.write(header)
                    for file in files[value]:
                        source, name = _store(file)
                        with source.open_input_stream(name, compression="zstd") as data:
                            while block := data.read(BLOCK):
                                out.write(block)
        return pa.table({"path": [f"{path}/{key[0].as_py()}.zip"], "members": pa.array([len(files)], pa.int32())})

    return made.groupBy("__archive").applyInArrow(packed, "path string, members int")
