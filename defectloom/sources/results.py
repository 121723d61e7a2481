"""Stored results with a life: a result is computed once for each state of its inputs' files and read while it is fresh."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Seconds for which answers to a question are kept, by the question.
LIFE_SECONDS = {"overview": 60, "files": 300, "importance": 600}


class Results:
    """Results under ``folder``, each by its question, its parameters and a fingerprint of its inputs.

    A result is a folder of Parquet files with a note beside them that is
    renamed into place when all is written; only a folder with a note is read.
    Two writers of one result write two folders, of which the later note
    counts, and readers of the former keep their files until :meth:`sweep`. No
    table is held in memory.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self._folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def fingerprint(self, inputs: Sequence[str]) -> str:
        """A hash of the names, sizes and times of all files of the inputs: it changes when any file does."""
        h = hashlib.sha256()
        for root in inputs:
            h.update(root.encode() + b"\0")
            files = self._fs_of(root).listFiles(self._path(root), True)
            found = []
            while files.hasNext():
                s = files.next()
                found.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
            h.update("\n".join(sorted(found)).encode() + b"\0")
        return h.hexdigest()

    def read(self, question: str, parameters: dict, inputs: Sequence[str], compute: Callable[[], DataFrame], life_seconds: float | None = None, now: datetime | None = None) -> DataFrame:
        """The fresh result for the question, the parameters and the inputs as they are, else a computed one, which is stored."""
        now = now or datetime.now(timezone.utc)
        life = timedelta(seconds=LIFE_SECONDS.get(question, 60) if life_seconds is None else life_seconds)
        place = self._place(question, parameters, self.fingerprint(inputs))
        note = self._note(place)
        if note is not None and datetime.fromisoformat(note["made"]) + life > now:
            return self._stored(f"{place}/{note['data']}", note["schema"])
        df, data = compute(), f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{place}/{data}")
        schema = df.schema.json()
        self._put(place, {"made": now.isoformat(), "data": data, "schema": schema, "question": question, "parameters": parameters})
        return self._stored(f"{place}/{data}", schema)

    def entries(self) -> DataFrame:
        """Rows (question, parameters, made, place) of all stored results."""
        rows = [(n["question"], json.dumps(n["parameters"], sort_keys=True), datetime.fromisoformat(n["made"]), p) for p in self._places() if (n := self._note(p)) is not None]
        return self._spark.createDataFrame(rows, "question string, parameters string, made timestamp, place string")

    def sweep(self, life_seconds: dict[str, float] | None = None, now: datetime | None = None) -> int:
        """Deletes results that are no longer fresh, and data that no note names; returns how many folders of data went. No reader may still hold them."""
        lives, now, gone = LIFE_SECONDS | (life_seconds or {}), now or datetime.now(timezone.utc), 0
        for place in self._places():
            note = self._note(place)
            fresh = note is not None and datetime.fromisoformat(note["made"]) + timedelta(seconds=lives.get(note["question"], 60)) > now
            for s in self._fs.listStatus(self._path(place)):
                name = s.getPath().getName()
                if name.startswith("data-") and not (fresh and name == note["data"]):
                    gone += 1
                    self._fs.delete(s.getPath(), True)
            if not fresh:
                self._fs.delete(self._path(place), True)
        return gone

    def _fs_of(self, path: str):
        return self._path(path).getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, question: str, parameters: dict, state: str) -> str:
        asked = json.dumps([question, parameters], sort_keys=True, default=str)
        return f"{self._folder}/{hashlib.sha256(f'{asked} {state}'.encode()).hexdigest()}"

    def _places(self) -> list[str]:
        root = self._path(self._folder)
        return [str(s.getPath().toString()) for s in self._fs.listStatus(root)] if self._fs.exists(root) else []

    def _note(self, place: str) -> dict | None:
        """The latest note; a name has its time, so that none is written over."""
        at = self._path(place)
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(at) if s.getPath().getName().startswith("note-")) if self._fs.exists(at) else []
        return json.loads(self._spark.read.text(f"{place}/{names[-1]}", wholetext=True).first()[0]) if names else None

    def _put(self, place: str, note: dict) -> None:
        name = f"note-{note['made'].replace(':', '')}-{uuid.uuid4().hex}"
        new = self._path(f"{place}/_{name}")
        out = self._fs.create(new, True)
        out.write(json.dumps(note).encode())
        out.close()
        if not self._fs.rename(new, self._path(f"{place}/{name}")):
            raise OSError(f"{place}/{name} cannot be put in place")

    def _stored(self, path: str, schema: str) -> DataFrame:
        return self._spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(path)
