"""Files that are there all at once or not at all.

Tasks write below a folder of their job's own, ``_job-...``.  When all have finished, the driver moves the files
to their names and then writes a manifest, one small file, which makes them count; if any
task fails, the job's folder is removed.  Readers take the files that manifests name, so that what a failed
or repeated task has left behind is never read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "_files-"


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: (name, path below the folder, rows, label)."""

    files: list[tuple[str, str, int, str]] = field(default_factory=list)


class FolderSink(DataSource):
    """Options: ``path``, a folder, and ``plan``, JSON for the writer.  Only for writing."""

    writer_class: type[FolderWriter]

    def schema(self):
        raise ValueError(f"{self.name()} is only written")

    def writer(self, schema, overwrite):
        return self.writer_class(self.options["path"], json.loads(self.options["plan"]), [f.name for f in schema.fields], uuid.uuid4().hex[:12])


class FolderWriter(DataSourceArrowWriter):
    """A subclass writes a task's batches by ``files``, which yields (name, bytes or pieces of them, rows, label)."""

    def __init__(self, folder: str, plan: dict, names: list[str], job: str):
        self.folder, self.plan, self.names, self.job = folder, plan, names, job

    def files(self, batches):
        raise NotImplementedError

    def write(self, iterator):
        store, inner = fs.FileSystem.from_uri(self.folder)
        done = Written()
        for name, data, rows, label in self.files(iterator):
            at = f"_job-{self.job}/{uuid.uuid4().hex}"
            store.create_dir(f"{inner}/_job-{self.job}", recursive=True)
            with store.open_output_stream(f"{inner}/{at}") as out:
                for piece in [data] if isinstance(data, bytes) else data:
                    out.write(piece)
            done.files.append((name, at, int(rows), label))
        return done

    def commit(self, messages):
        store, inner = fs.FileSystem.from_uri(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        if len({f[0] for f in files}) < len(files):
            self.abort(messages)
            raise ValueError(f"{self.folder}: tasks wrote files of the same names")
        store.create_dir(inner, recursive=True)
        for name, at, _, _ in files:
            store.move(f"{inner}/{at}", f"{inner}/{name}")
        listed = [{"name": name, "rows": rows, "label": label} for name, _, rows, label in files]
        with store.open_output_stream(f"{inner}/_new-{self.job}") as out:
            out.write(json.dumps({"job": self.job, "files": listed}).encode())
        store.move(f"{inner}/_new-{self.job}", f"{inner}/{MANIFEST}{self.job}.json")
        self._clear(store, inner)

    def abort(self, messages):
        self._clear(*fs.FileSystem.from_uri(self.folder))

    def _clear(self, store, inner):
        if store.get_file_info(f"{inner}/_job-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{inner}/_job-{self.job}")


def manifests(folder: str) -> dict[str, list[dict]]:
    """By job the files that a folder's manifests name; empty where there is no manifest."""
    store, inner = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else f"/{folder}")
    if store.get_file_info(inner).type != fs.FileType.Directory:
        return {}
    found = {}
    for info in store.get_file_info(fs.FileSelector(inner)):
        if info.base_name.startswith(MANIFEST):
            with store.open_input_stream(info.path) as f:
                told = json.loads(f.read())
            found[told["job"]] = told["files"]
    return found


def committed(folder: str, label: str | None = None) -> list[str] | None:
    """Paths of the files that count in a folder, sorted, of one label or all; None without a manifest, as in
    folders of others' files.  A name that was written again is one file."""
    known = manifests(folder)
    if not known:
        return None
    return sorted({f"{folder.rstrip('/')}/{f['name']}" for files in known.values() for f in files if label in (None, f["label"])})


def save_files(rows: DataFrame, sink: type[FolderSink], folder: str, plan: dict) -> DataFrame:
    """Writes all ``rows`` by ``sink`` and returns (label, path, rows) of the new files."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(sink)
    before = set(manifests(folder))
    rows.write.format(sink.name()).option("plan", json.dumps(plan)).mode("append").save(folder)
    new = [(f["label"], f"{folder}/{f['name']}", f["rows"]) for job, files in manifests(folder).items() if job not in before for f in files]
    return spark.createDataFrame(sorted(new), "label string, path string, rows long")
