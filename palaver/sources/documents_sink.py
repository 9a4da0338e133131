"""A Spark data source that writes one file for each row, at the path that the row names.

    docs.select("rel_path", "body").write.format("documents_by_path").mode("append").save("/exports")

A task writes its documents below a staging folder and moves them into place when it has all; a task that
fails leaves nothing at a final path, its next attempt begins anew, and a document is never seen half
written. Rows that can't be written (a null body, a path that leaves the root or that the store
refuses) fail alone. What became of each row stands below ``.status/<job>``; the staging folder goes with the job.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import storage

FORMAT = "documents_by_path"
SCHEMA = "rel_path string, body string"


@dataclass
class Written(WriterCommitMessage):
    written: int
    failed: int


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        names = [f.name for f in schema.fields]
        if "rel_path" not in names or "body" not in names:
            raise ValueError("rel_path and body are needed")
        return _Writer(self.options["path"], self.options.get("job") or uuid.uuid4().hex)


class _Writer(DataSourceWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job = root, job

    def write(self, iterator: Iterator) -> Written:
        store, at = storage.opened(self.root)
        task = TaskContext.get()
        staging = f"{at}/.staging-{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        status, moves = [], []
        store.create_dir(staging)
        for k, row in enumerate(iterator):
            problem = _problem(row["rel_path"], row["body"])
            if problem is None:
                try:
                    with store.open_output_stream(f"{staging}/{k}") as out:
                        out.write(row["body"].encode("utf-8", "surrogatepass"))
                    moves.append((len(status), f"{staging}/{k}", f"{at}/{row['rel_path']}"))
                except OSError as e:
                    problem = str(e)
            status.append({"rel_path": row["rel_path"], "status": "written" if problem is None else "failed", "problem": problem})
        folders: set[str] = set()
        for k, source, target in moves:
            try:
                if (folder := posixpath.dirname(target)) not in folders:
                    store.create_dir(folder)
                    folders.add(folder)
                store.move(source, target)
            except OSError as e:
                status[k] |= {"status": "failed", "problem": str(e)}
        folder = f"{at}/.status/{self.job}"
        store.create_dir(folder)
        with store.open_output_stream(f"{staging}/status") as out:
            out.write("".join(json.dumps(s) + "\n" for s in status).encode())
        store.move(f"{staging}/status", f"{folder}/part-{task.partitionId():06d}.json")
        written = sum(s["status"] == "written" for s in status)
        return Written(written, len(status) - written)

    def commit(self, messages: list) -> None:
        self._clean()

    def abort(self, messages: list) -> None:
        self._clean()

    def _clean(self) -> None:
        store, at = storage.opened(self.root)
        try:
            store.delete_dir(f"{at}/.staging-{self.job}")
        except FileNotFoundError:
            pass


def _problem(rel_path: str | None, body: str | None) -> str | None:
    """Why a row can't be written."""
    if body is None:
        return "no body"
    steps = (rel_path or "").split("/")
    if "" in steps or ".." in steps or "." in steps or rel_path.startswith("."):
        return "not a path below the root"
    return None


def write(docs: DataFrame, root: str) -> DataFrame:
    """Write (rel_path, body) rows below ``root``, folder by folder; returns rel_path, status and problem of every row.
    Writing again gives the same files."""
    spark, job = docs.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(DocumentSink)
    dealt = docs.select("rel_path", "body").repartitionByRange("rel_path")
    dealt.write.format(FORMAT).option("job", job).mode("append").save(root)
    return spark.read.schema("rel_path string, status string, problem string").json(f"{root}/.status/{job}")
