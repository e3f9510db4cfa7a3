"""Small files in a folder that driver and executors share: text, listings, and a commit that only one writer wins.

Every path goes to the file system its scheme names, so state may lie on HDFS, an object store or a mounted folder.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def _at(self, path: str):
        p = self._path(path)
        fs = p.getFileSystem(self._spark._jsc.hadoopConfiguration())
        return fs, fs.makeQualified(p)

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; hidden ones (., _) are left out. A folder that isn't there has none."""
        fs, p = self._at(folder)
        if not fs.exists(p):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if not n.startswith((".", "_")))

    def data_files(self, path: str) -> list[tuple[str, int, int]]:
        """(path, size, time of change in ms) of each data file at or below a path."""
        fs, p = self._at(path)
        out, it = [], fs.listFiles(p, True)
        while it.hasNext():
            s = it.next()
            if not s.getPath().getName().startswith(("_", ".")):
                out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return out

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def replace(self, path: str, text: str) -> None:
        """Write a file, in the place of an older one. Readers see the older one or the whole newer one."""
        fs, p = self._at(path)
        temp = f"{p.getParent()}/.{uuid.uuid4().hex}.tmp"
        self._put(temp, text)
        jvm = self._spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._spark._jsc.hadoopConfiguration())
        options = self._spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path(temp), p, options)

    def put_new(self, path: str, text: str) -> bool:
        """Write a file unless one of that name is there, whole or not at all: of several writers one gets True.

        On a mounted folder by a hard link, on HDFS by a rename that never replaces, on object stores by a create that never
        overwrites (as atomic as the store's conditional put).
        """
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        scheme = p.toUri().getScheme()
        if scheme == "file":
            final = unquote(urlparse(p.toString()).path)
            temp = os.path.join(os.path.dirname(final), f".{uuid.uuid4().hex}.tmp")
            with open(temp, "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(temp, final)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(temp)
        from py4j.protocol import Py4JJavaError

        try:
            if scheme.startswith("s3"):
                out = fs.create(p, False)
                out.write(bytearray(text.encode()))
                out.close()
            else:
                temp = f"{p.getParent()}/.{uuid.uuid4().hex}.tmp"
                self._put(temp, text)
                jvm = self._spark._jvm
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._spark._jsc.hadoopConfiguration())
                context.rename(self._path(temp), p, self._spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def qualified(self, path: str) -> str:
        return self._at(path)[1].toString()


class LocalFiles:
    """The same for a folder of this machine, without a session."""

    def exists(self, path: str) -> bool:
        return os.path.exists(path)

    def read(self, path: str) -> str:
        with open(path) as f:
            return f.read()

    def replace(self, path: str, text: str) -> None:
        temp = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(temp, "w") as f:
            f.write(text)
        os.replace(temp, path)
