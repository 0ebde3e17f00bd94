"""Folders of generations as a data source: <problem>/generation_<i>_coh_<x>[_acc_<y>]/ with the files of each generation.

The files are gen.txt, prog.txt, formatted_prog.txt, output_record.json and, for directed problems, diff.txt. Reading lists the
problems and gives each task some of them; filters on problem_id leave out whole folders, and columns that nobody asks for are
not opened. Writing goes through a folder of each task beside the problems, and only what all tasks have written moves to its
place; where one fails nothing stays. Paths are of any store that pyarrow knows by its address, or local.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "problem_id string, generation_id int, coherence double, accuracy double, generation string, program string, formatted_program string, output_record string, diff string"
#: Files of a generation by column.
FILES = {"generation": "gen.txt", "program": "prog.txt", "formatted_program": "formatted_prog.txt", "output_record": "output_record.json", "diff": "diff.txt"}
_FOLDER = re.compile(r"generation_(\d+)_coh_([^_]+)(?:_acc_([^_]+))?$")
_STAGED = "_staged"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _number(text: str | None) -> float | None:
    """Null for None and what is no number, as true and false written in words are 1 and 0."""
    words = {"True": 1.0, "False": 0.0, "None": None, None: None}
    if text in words:
        return words[text]
    try:
        return float(text)
    except ValueError:
        return None


def folder_name(generation_id: int, coherence: float | None, accuracy: float | None, directed: bool) -> str:
    """Of a generation; undirected problems have no accuracy in it."""
    return f"generation_{generation_id}_coh_{coherence}" + (f"_acc_{accuracy}" if directed else "")


@dataclass
class _Problems(InputPartition):
    names: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, per_task: int) -> None:
        self.path, self.schema, self.per_task, self.wanted = path, schema, per_task, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else tuple(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("problem_id",):
                self.wanted = set(values) if self.wanted is None else self.wanted & set(values)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = _opened(self.path)
        found = [i.base_name for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and not i.base_name.startswith("_")]
        names = sorted(n for n in found if self.wanted is None or n in self.wanted)
        return [_Problems(tuple(names[i : i + self.per_task])) for i in range(0, len(names), self.per_task)] or [_Problems(())]

    def read(self, partition: _Problems) -> Iterator[tuple]:
        store, root = _opened(self.path)
        for problem in partition.names:
            folders = store.get_file_info(fs.FileSelector(posixpath.join(root, problem)))
            for folder in sorted(folders, key=lambda i: i.base_name):
                hit = _FOLDER.match(folder.base_name)
                if not hit:
                    continue
                values = {"problem_id": problem, "generation_id": int(hit[1]), "coherence": _number(hit[2]), "accuracy": _number(hit[3])}
                yield tuple(values[c] if c in values else self._text(store, posixpath.join(folder.path, FILES[c])) for c in self.schema.names)

    def _text(self, store: fs.FileSystem, path: str) -> str | None:
        if store.get_file_info(path).type != fs.FileType.File:
            return None
        with store.open_input_stream(path) as f:
            return f.read().decode("utf-8", "replace")


@dataclass
class _Written(WriterCommitMessage):
    stage: str
    folders: tuple[str, ...]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, directed: bool, overwrite: bool) -> None:
        self.path, self.names, self.directed, self.overwrite, self.job = path, schema.names, directed, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> _Written:
        """One task's generations below a folder of its own, as another attempt may write the same ones."""
        store, root = _opened(self.path)
        stage, folders = posixpath.join(root, _STAGED, self.job, uuid.uuid4().hex), []
        for row in iterator:
            r = dict(zip(self.names, row, strict=True))
            if r["problem_id"] is None or r["generation_id"] is None or "/" in r["problem_id"] or r["problem_id"].startswith(("_", ".")):
                raise ValueError(f"no folder can have the name of problem {r['problem_id']!r}, generation {r['generation_id']!r}")
            folder = posixpath.join(r["problem_id"], folder_name(r["generation_id"], r.get("coherence"), r.get("accuracy"), self.directed))
            store.create_dir(posixpath.join(stage, folder), recursive=True)
            for column, file in FILES.items():
                if r.get(column) is not None and (column != "diff" or self.directed):
                    text = f"Accuracy: {r.get('accuracy')}\n{r['diff']}" if column == "diff" else r[column]
                    with store.open_output_stream(posixpath.join(stage, folder, file)) as f:
                        f.write(text.encode())
            folders.append(folder)
        return _Written(stage, tuple(folders))

    def commit(self, messages: list[_Written | None]) -> None:
        """Moves every generation to its place; the last one of a place that two rows have stays."""
        store, root = _opened(self.path)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.type == fs.FileType.Directory and info.base_name != _STAGED:
                    store.delete_dir(info.path)
        for m in messages:
            for folder in m.folders if m else ():
                target = posixpath.join(root, folder)
                store.create_dir(posixpath.dirname(target), recursive=True)
                if store.get_file_info(target).type == fs.FileType.Directory:
                    store.delete_dir(target)
                store.move(posixpath.join(m.stage, folder), target)
        self._clean(store, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean(*_opened(self.path))

    def _clean(self, store: fs.FileSystem, root: str) -> None:
        for path in (posixpath.join(root, _STAGED, self.job), posixpath.join(root, _STAGED)):
            info = store.get_file_info(path)
            if info.type == fs.FileType.Directory and (path.endswith(self.job) or not store.get_file_info(fs.FileSelector(path))):
                store.delete_dir(path)


class RecordTree(DataSource):
    """Format record_tree; options path, per_task (problems of a reading task), directed (whether folders have accuracies)."""

    @classmethod
    def name(cls) -> str:
        return "record_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        unknown = set(schema.names) - {"problem_id", "generation_id", "coherence", "accuracy", *FILES}
        if unknown:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        return _Reader(self.options["path"], schema, int(self.options.get("per_task", 16)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, self.options.get("directed", "true").lower() == "true", overwrite)


def write_tree(frame: DataFrame, path: str, directed: bool = True, mode: str = "append") -> None:
    """frame has problem_id, generation_id and any other columns of SCHEMA; diff is written for directed problems only, below the
    accuracy."""
    frame.sparkSession.dataSource.register(RecordTree)
    frame.write.format("record_tree").option("directed", str(directed).lower()).mode(mode).save(path)


def read_tree(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """columns as DDL: files of others are not opened. Filters on problem_id reach the listing if
    spark.sql.python.filterPushdown.enabled is on, which this sets."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordTree)
    return spark.read.format("record_tree").schema(columns).load(path)


