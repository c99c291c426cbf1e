"""A queue of jobs in a shared folder, delivered at least once, and a sink of event frames that are written once.

Both are data sources of Spark, so jobs are reserved, acknowledged and recovered by a query's own offsets and commits:

- ``jobs/``: files of jobs that wait, put there whole by a rename after the writing job has ended.
- ``reserved/``: one file a batch, with the names of the job files that it has been given. It is written before the batch
  runs, so a batch that runs again gets the same jobs, and no other batch gets them.
- ``done/``: job files of batches that Spark has committed, which is the acknowledgement.

A worker that dies between reserving and acknowledging leaves its reservation; the query that starts next from the same
checkpoint is given the batch again, and one that starts without a checkpoint is given all that was never acknowledged.

Folders are named by a path or any URI that ``pyarrow.fs`` opens, and must be shared by the driver and all executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row, StructType

JOB = "job_id string, tenant_id string, user_id string, task_id string, attempt int, enqueued_at timestamp"
# How often a job is tried, and the events after which a task says no more.
ATTEMPTS = 3
TERMINAL = ("completed", "failed")


class Folder:
    """Files below one folder."""

    def __init__(self, uri: str):
        self.fs, self.path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
        self.path = self.path.rstrip("/")

    def names(self, part: str) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/{part}", allow_not_found=True))
        return sorted(x.base_name for x in found if x.is_file and not x.base_name.startswith((".", "_")))

    def put(self, part: str, name: str, text: str) -> None:
        """A whole file or none: written under another name, then renamed."""
        self.fs.create_dir(f"{self.path}/{part}")
        draft = f"{self.path}/{part}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(text.encode())
        self.fs.move(draft, f"{self.path}/{part}/{name}")

    def get(self, part: str, name: str) -> str | None:
        path = f"{self.path}/{part}/{name}"
        if self.fs.get_file_info(path).type != fs.FileType.File:
            return None
        with self.fs.open_input_stream(path) as f:
            return f.read().decode()

    def move(self, name: str, part: str, to: str) -> None:
        """Does nothing where it has been moved already."""
        if self.fs.get_file_info(f"{self.path}/{part}/{name}").type == fs.FileType.File:
            self.fs.create_dir(f"{self.path}/{to}")
            self.fs.move(f"{self.path}/{part}/{name}", f"{self.path}/{to}/{name}")

    def delete(self, part: str, name: str) -> None:
        if self.fs.get_file_info(f"{self.path}/{part}/{name}").type == fs.FileType.File:
            self.fs.delete_file(f"{self.path}/{part}/{name}")


class JobFile(InputPartition):
    def __init__(self, name: str):
        self.name = name


class QueueReader(DataSourceStreamReader):
    """Offsets are numbers of batches; the jobs of a batch stand in its reservation."""

    def __init__(self, options: dict):
        self.path, self.files = options["path"], int(options.get("filesPerBatch", 1000))

    def _reserved(self, folder: Folder) -> list[int]:
        return [int(x.removesuffix(".json")) for x in folder.names("reserved")]

    def initialOffset(self) -> dict:
        folder = Folder(self.path)
        done = folder.get("acknowledged", "last.json")
        return {"batch": json.loads(done)["batch"] if done else 0}

    def latestOffset(self) -> dict:
        folder = Folder(self.path)
        batches = self._reserved(folder)
        taken = {name for b in batches for name in json.loads(folder.get("reserved", f"{b}.json") or "[]")}
        waiting = [x for x in folder.names("jobs") if x not in taken][: self.files]
        last = max(batches, default=self.initialOffset()["batch"])
        if waiting:
            last += 1
            folder.put("reserved", f"{last}.json", json.dumps(waiting))
        return {"batch": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        folder = Folder(self.path)
        return [JobFile(x) for b in range(start["batch"] + 1, end["batch"] + 1) for x in json.loads(folder.get("reserved", f"{b}.json") or "[]")]

    def read(self, partition: JobFile) -> Iterator[tuple]:
        folder = Folder(self.path)
        text = folder.get("jobs", partition.name)
        for line in (folder.get("done", partition.name) or "" if text is None else text).splitlines():
            j = json.loads(line)
            yield j["job_id"], j["tenant_id"], j["user_id"], j["task_id"], j["attempt"], pd.Timestamp(j["enqueued_at"]).to_pydatetime()

    def commit(self, end: dict) -> None:
        folder = Folder(self.path)
        for b in sorted(x for x in self._reserved(folder) if x <= end["batch"]):
            for name in json.loads(folder.get("reserved", f"{b}.json") or "[]"):
                folder.move(name, "jobs", "done")
            folder.put("acknowledged", "last.json", json.dumps({"batch": b}))
            folder.delete("reserved", f"{b}.json")


class Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class QueueWriter(DataSourceWriter):
    """Each task writes one file aside; the files are put into the queue when all tasks have ended."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator[Row]) -> Written:
        lines = [json.dumps({"job_id": r.job_id, "tenant_id": r.tenant_id, "user_id": r.user_id, "task_id": r.task_id, "attempt": r.attempt or 0, "enqueued_at": str(r.enqueued_at)}) for r in rows]
        if not lines:
            return Written(None)
        name = f"{uuid.uuid4().hex}.jsonl"
        Folder(self.path).put("aside", name, "\n".join(lines))
        return Written(name)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m and m.name:
                Folder(self.path).move(m.name, "aside", "jobs")

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and m.name:
                Folder(self.path).delete("aside", m.name)


class JobQueue(DataSource):
    """``path``: the folder; ``filesPerBatch``: how many job files a batch reserves at most."""

    @classmethod
    def name(cls) -> str:
        return "job_queue"

    def schema(self) -> str:
        return JOB

    def streamReader(self, schema: StructType) -> QueueReader:
        return QueueReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> QueueWriter:
        return QueueWriter(self.options)


class FrameWriter(DataSourceStreamWriter):
    """A batch's frames are one file a task, listed in a manifest; a batch that runs again finds its manifest and adds nothing."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator[Row]) -> Written:
        text = "".join(f"event: {r.event}\ndata: {r.data}\n\n" for r in rows)
        if not text:
            return Written(None)
        name = f"{uuid.uuid4().hex}.sse"
        Folder(self.path).put("frames", name, text)
        return Written(name)

    def commit(self, messages: list, batchId: int) -> None:
        folder, names = Folder(self.path), [m.name for m in messages if m and m.name]
        if folder.get("batches", f"{batchId:012d}.json") is None:
            folder.put("batches", f"{batchId:012d}.json", json.dumps(names))
        else:
            self._drop(names)

    def abort(self, messages: list, batchId: int) -> None:
        self._drop([m.name for m in messages if m and m.name])

    def _drop(self, names: list[str]) -> None:
        for x in names:
            Folder(self.path).delete("frames", x)


class EventFrames(DataSource):
    """Sink for (event string, data string); ``path`` is the folder. Subscribers read the files of committed batches."""

    @classmethod
    def name(cls) -> str:
        return "event_frames"

    def schema(self) -> str:
        return "event string, data string"

    def streamWriter(self, schema: StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options)


def frames_since(path: str, batch: int = -1) -> Iterator[tuple[int, str]]:
    """(batch, text) of the frame files of batches after ``batch``, as a subscriber takes them up."""
    folder = Folder(path)
    for b in folder.names("batches"):
        if int(b.removesuffix(".json")) > batch:
            for name in json.loads(folder.get("batches", b) or "[]"):
                yield int(b.removesuffix(".json")), folder.get("frames", name) or ""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JobQueue)
    spark.dataSource.register(EventFrames)


def enqueue(jobs: DataFrame, path: str) -> None:
    """Puts ``jobs`` (the columns of ``JOB``) into the queue, all or none."""
    jobs.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(JOB)]).write.format("job_queue").option("path", path).mode("append").save()


def delivered(spark: SparkSession, path: str, within: str = "1 hour", files: int = 1000) -> DataFrame:
    """The queue as a stream; a job that was enqueued twice ``within`` that time, with equal id and attempt, comes once."""
    d = spark.readStream.format("job_queue").option("path", path).option("filesPerBatch", str(files)).load()
    return d.withWatermark("enqueued_at", within).dropDuplicatesWithinWatermark(["job_id", "attempt"])


def retried(failed: DataFrame, path: str, now: Column, attempts: int = ATTEMPTS) -> DataFrame:
    """Puts the jobs that failed back with one attempt more; gives those that have had all their attempts."""
    more = failed.withColumns({"attempt": F.col("attempt") + 1, "enqueued_at": now})
    enqueue(more.where(F.col("attempt") < attempts), path)
    return failed.where(F.col("attempt") + 1 >= attempts)


class Tail(StatefulProcessor):
    """Value state of a task: how many events it has had, and whether it has ended."""

    def __init__(self, key: str, after: int):
        self.key, self.after = key, after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("task", "seen long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, ended = self.state.get() if self.state.exists() else (0, False)
        if ended:
            return
        d = pd.concat(list(rows)).sort_values("event_id", kind="stable")
        last = d["event"].isin(TERMINAL).to_numpy()
        stop = int(last.argmax()) + 1 if last.any() else len(d)
        at = range(seen, seen + stop)
        d = d.iloc[:stop].assign(place=list(at))
        self.state.update((seen + stop, bool(last.any())))
        d = d[d["place"] >= self.after]
        if len(d):
            yield d[[self.key, "place", "event_id", "event", "data"]]

    def close(self) -> None:
        pass


def tailed(log: DataFrame, key: str = "task_id", after: int = 0) -> DataFrame:
    """(key, place, event_id, event, data): of each task of the stream ``log`` the events from place ``after`` on, old ones and
    those that still come, up to the first that ends it. Events are ordered by id inside a batch, and batches as they come."""
    d = log.select(key, "event_id", "event", "data")
    return d.groupBy(key).transformWithStateInPandas(Tail(key, after), f"`{key}` {dict(log.dtypes)[key]}, place long, event_id long, event string, data string", "Append", "None")
