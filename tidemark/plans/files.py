"""Small files and folders of a store, in any file system that Spark reaches."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = path.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(path).toString().rstrip("/")
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder))) if self.exists(folder) else []

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Make a file that appears whole or not at all; False if there is one of that name."""
        folder, _, last = name.rpartition("/")
        rough = f"{folder}/.{last}.{uuid.uuid4().hex}".lstrip("/")
        stream = self._fs.create(self._at(rough), False)
        stream.write(bytearray(data))
        stream.hsync() if hasattr(stream, "hsync") else None
        stream.close()
        none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self._context.rename(self._at(rough), self._at(name), none)
        except Py4JJavaError as e:
            self._fs.delete(self._at(rough), False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def make_folder(self, name: str) -> None:
        self._fs.mkdirs(self._at(name))

    def delete(self, name: str) -> int:
        """Delete a file or folder; how many bytes it had (0 if it wasn't there)."""
        at = self._at(name)
        if not self._fs.exists(at):
            return 0
        size = self._fs.getContentSummary(at).getLength()
        self._fs.delete(at, True)
        return size

    def walk(self, folder: str) -> list[tuple[str, int, int]]:
        """Every file below: its name relative to the root, bytes, and when it was written (milliseconds)."""
        if not self.exists(folder):
            return []
        found, every = [], self._fs.listFiles(self._at(folder), True)
        while every.hasNext():
            s = every.next()
            found.append((s.getPath().toString().removeprefix(f"{self.root}/"), s.getLen(), s.getModificationTime()))
        return sorted(found)
