"""Files of any store that Spark's Hadoop FileSystem reaches: what a driver needs besides reading and writing tables."""

from __future__ import annotations

import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

from samewise.errors import ConfigurationError
from samewise.sources.shared import shared_dir


class Store:
    """A folder, in the store that its scheme names, else in the session's default one.

    On a cluster a folder of the machine's own disk would be another one on every machine, so it raises there, unless
    it lies in the shared folder that spark.checkpoint.dir names.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = self._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = path.getFileSystem(self._conf)
        self.folder: str = self._fs.makeQualified(path).toString().rstrip("/")
        if self._fs.getUri().getScheme() == "file" and not spark.sparkContext.master.startswith("local"):
            shared = self._fs.makeQualified(self._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))).toString().rstrip("/")
            if not f"{self.folder}/".startswith(f"{shared}/"):
                raise ConfigurationError("a folder of one machine does not serve a cluster", folder=self.folder, shared=shared)

    def path(self, name: str = "") -> str:
        return f"{self.folder}/{name}" if name else self.folder

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name if "://" in name or name.startswith(("/", "file:")) else self.path(name))

    def make(self) -> None:
        self._fs.mkdirs(self._path(self.folder))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self) -> list[str]:
        """Files and folders directly in the folder, none if it is not there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))) if self.exists(self.folder) else []

    def size(self, name: str) -> int:
        """Bytes of a file or of all files of a folder."""
        return self._fs.getContentSummary(self._path(name)).getLength()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """All of the file or nothing: it is written under another name and renamed onto its own."""
        new = self._path(f"{name}.{uuid.uuid4().hex}.new")
        stream = self._fs.create(new, True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = SparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(new, self._path(name), options)

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(name), True)

    def copy(self, name: str, target: Store, to: str) -> None:
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(name), target._fs, target._path(to), False, True, self._conf)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, of any store, is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
