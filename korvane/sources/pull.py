"""A pull source for streams: the files of a folder, oldest first, each line a draft of a post.

``spark.dataSource.register(PullSource)``, then ``spark.readStream.format("drafts").option("path", folder)``. The
offset is the place of the last file taken, by time of change and name, so a query that starts again from its checkpoint takes up
where it stopped. A file is to be put in place whole (renamed into the folder); names that begin with a dot or underscore are passed over.
The folder is one that the driver and all executors see.

Defined results: a line that is no JSON object, or lacks a source or content, is a row with ``fault`` and without the
rest, and stops nothing; an unreadable file is one such row; empty lines are passed over; further fields of a line are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, line long, source string, id long, request_key string, org long, type string, content string, fault string"


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


def draft(text: str) -> tuple:
    """The fields of a line behind its place, or a fault."""
    try:
        got = json.loads(text)
    except ValueError:
        return (None,) * 6 + ("not JSON",)
    if not isinstance(got, dict):
        return (None,) * 6 + ("not an object",)
    fields = [(got.get(k), t) for k, t in (("source", str), ("id", int), ("request_key", str), ("org", int), ("type", str), ("content", str))]
    if not fields[0][0] or not fields[5][0]:
        return (None,) * 6 + ("no source or content",)
    if any(v is not None and (not isinstance(v, t) or isinstance(v, bool)) for v, t in fields):
        return (None,) * 6 + ("wrong type",)
    return (*(v for v, _ in fields), None)


class PullReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def _files(self) -> list[tuple[int, str]]:
        with os.scandir(self.folder) as found:
            return sorted((f.stat().st_mtime_ns, f.name) for f in found if f.is_file() and f.name[0] not in "._")

    def initialOffset(self) -> dict:
        return {"changed": 0, "name": ""}

    def latestOffset(self) -> dict:
        files = self._files()
        return {"changed": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        low, high = ((o["changed"], o["name"]) for o in (start, end))
        return [FilePart(os.path.join(self.folder, name)) for changed, name in self._files() if low < (changed, name) <= high]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        name = os.path.basename(partition.path)
        try:
            with open(partition.path, encoding="utf-8") as f:
                for i, text in enumerate(f):
                    if text.strip():
                        yield (name, i, *draft(text))
        except (OSError, UnicodeDecodeError) as e:
            yield (name, None, *(None,) * 6, type(e).__name__)

    def commit(self, end: dict) -> None:
        """Nothing to release: files stay, and the checkpoint holds the offset."""


class PullSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "drafts"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PullReader:
        return PullReader(self.options)
