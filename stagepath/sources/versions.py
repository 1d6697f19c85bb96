"""Stored tables that are replaced as a whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from stagepath.staging import remove_folder


class Conflict(RuntimeError):
    """Another build has published a version since this one began."""


class VersionedFolder:
    """A folder of tables of which readers see one finished version at a time.

    Each version is written to a folder of its own. It becomes the current one when a
    pointer with the next number is created, which the store does for one writer
    only and all at once. Until then, and if the build fails, the version before stays in place, and
    those who read it go on undisturbed. Readers of Parquet pass over the pointers, as
    their folder begins with an underscore.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._pointers = f"{self.path}/_versions"

    def _at(self, path: str) -> tuple[Any, Any]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _read(self, number: int) -> dict[str, Any] | None:
        place, store = self._at(f"{self._pointers}/{number:012d}")
        stream = store.open(place)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        # A writer that was lost between creating a pointer and filling it leaves it short.
        return json.loads(text) if text.endswith("\n") else None

    def numbers(self) -> list[int]:
        """The numbers of all pointers, the latest first."""
        place, store = self._at(self._pointers)
        if not store.exists(place):
            return []
        names = (status.getPath().getName() for status in store.listStatus(place))
        return sorted((int(name) for name in names if name.isdigit()), reverse=True)

    def current(self) -> dict[str, Any] | None:
        """What was published last: its `folder` and the facts given with it; None without any."""
        for number in self.numbers():
            found = self._read(number)
            if found is not None:
                return found | {"number": number}
        return None

    def publish(
        self, write: Callable[[str], dict[str, Any]], since: int | None = None, keep: int = 2
    ) -> dict[str, Any]:
        """Lets `write` fill a new folder and makes it current, with the facts it returns.

        `since` is the number of the version that the new one builds on, if it does. With another
        published meanwhile, Conflict is raised and nothing changes. The last `keep` versions stay for
        those who still read them, older ones are removed.
        """
        last = max(self.numbers(), default=0)
        if since is not None and since != last:
            raise Conflict(f"{self.path} is at version {last}, not {since}")
        folder = f"{self.path}/v-{uuid.uuid4().hex}"
        try:
            facts = write(folder) | {"folder": folder}
            self._point(last + 1, facts)
        except BaseException:
            remove_folder(self.spark, folder)
            raise
        self._prune(keep)
        return facts | {"number": last + 1}

    def _point(self, number: int, facts: dict[str, Any]) -> None:
        place, store = self._at(f"{self._pointers}/{number:012d}")
        try:
            stream = store.create(place, False)
        except Py4JJavaError as error:
            if store.exists(place):
                raise Conflict(f"{self.path} has got a version {number} meanwhile") from error
            raise
        try:
            stream.write(bytearray((json.dumps(facts) + "\n").encode()))
        finally:
            stream.close()

    def _prune(self, keep: int) -> None:
        for number in self.numbers()[keep:]:
            found = self._read(number)
            if found is not None:
                remove_folder(self.spark, found["folder"])
            remove_folder(self.spark, f"{self._pointers}/{number:012d}")
