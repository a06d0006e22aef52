"""Small files and names beside tables, in whatever file system the path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """Reads, writes, renames and deletes below one folder, through Hadoop's file systems, as Spark itself does."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.root = path.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none if it is not there."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A new file; an error if the name is taken."""
        stream = self._fs.create(self._path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        """Give a file a name that no other has; False if one has it. One step where the file system renames in one step."""
        return not self.exists(new) and self._fs.rename(self._path(old), self._path(new))

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(name), True)
