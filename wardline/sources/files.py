"""Small files and folders in whatever storage the session's paths lie in.

Names without a scheme are on Spark's default file system, as everywhere in Spark. For
configuration, pointers and clearing up; tables are read and written by Spark itself.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """The file system that ``root`` is in."""

    def __init__(self, spark: SparkSession, root: str):
        self._gateway = spark.sparkContext._gateway
        self._hadoop = spark._jvm.org.apache.hadoop
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path().getFileSystem(conf)
        self._context = self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _path(self, name: str = ""):
        return self._hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """What is directly below a folder; nothing if there is no such folder."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def read(self, name: str = "") -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a small file so that readers see the old text or the new, never a part."""
        draft = self._path(f"{name}.draft")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = getattr(self._hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._context.rename(draft, self._path(name), options)

    def remove(self, name: str) -> None:
        """Delete a file or a folder with all below it, if it is there."""
        self._fs.delete(self._path(name), True)
