"""Small files of the catalog, on any file system that Spark reaches."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):  # noqa: ANN202
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Replace a file; readers see the old or the new text."""
        self._put(path, text, "OVERWRITE")

    def create(self, path: str, text: str) -> bool:
        """Write a file unless there is one; whether it was written. Readers see it whole or not at all."""
        try:
            self._put(path, text, "NONE")
        except Py4JJavaError as e:
            if not self.exists(path):
                raise
            if "exist" not in str(e.java_exception):
                raise
            return False
        return True

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def _put(self, path: str, text: str, how: str) -> None:
        fs, p = self._at(path)
        temp = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
        stream = fs.create(temp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = getattr(rename, how)
        try:
            context.rename(temp, p, options)
        except Py4JJavaError:
            fs.delete(temp, False)
            raise

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
