"""Files of any store that Spark reaches, through Hadoop's FileSystem."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lamellar import faults
from lamellar.errors import FileMissing, InvalidArgument


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir; in a single local process a local one will do."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise InvalidArgument("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lamellar-"))
    base = named or sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def normal(path: str) -> str:
    """A comparable form: file:/x, file:///x and /x are one, escapes are undone, account parts of an authority go."""
    u = urlparse(path)
    if not u.scheme or u.scheme == "file":
        return unquote(u.path)
    host = u.netloc.split("@")
    return f"{u.scheme}://{host[0] if len(host) == 2 else u.netloc}{unquote(u.path)}"


def plain_path(path: Column) -> Column:
    """normal() as a column expression, for paths without escapes of their own."""
    local = F.regexp_replace(path, "^file:(//)?", "")
    return F.url_decode(F.regexp_replace(F.regexp_replace(local, "^([a-z0-9]+://)([^@/]+)@[^/]+", "$1$2"), "\\+", "%2B"))


#: Schemes of stores where a file appears when it is closed.
OBJECT_STORES = ("s3", "s3a", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "cosn")


class Store:
    """The file system of a path: text files, listings and exclusive creation."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def at(self, path: str) -> str:
        """A path of the table: relative ones stand below the root."""
        return path if "://" in path or path.startswith(("/", "file:")) else f"{self.root}/{path}"

    def relative(self, path: str) -> str:
        own, root = normal(self.at(path)), normal(self.root) + "/"
        return own[len(root) :] if own.startswith(root) else path

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(self.at(path)))

    def names(self, path: str) -> list[str]:
        """Files right below a folder, sorted; none if it isn't there."""
        faults.hit("list_files")
        if not self.exists(path):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(self.at(path))) if x.isFile())

    def total_size(self, path: str) -> int:
        """Bytes of a folder's files."""
        return sum(x.getLen() for x in self._fs.listStatus(self._path(self.at(path))) if x.isFile())

    def size(self, path: str) -> int:
        return self._fs.getFileStatus(self._path(self.at(path))).getLen()

    def read(self, path: str) -> str:
        try:
            stream = self._fs.open(self._path(self.at(path)))
        except Py4JJavaError as e:
            raise FileMissing(path) from e
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file that must be new, whole or not at all; False if it is there already.

        The text goes to a hidden file first, which then gets its name in one step
        that fails if the name is taken: a hard link on a local disk, a rename
        without overwrite (atomic on HDFS) elsewhere.  An object store shows a file
        only when it is whole, so there it is created under its name; that two
        writers can't both do so needs the connector's conditional put.
        """
        target = self._path(self.at(path))
        if self._fs.getScheme() in OBJECT_STORES:
            return self._written(target, text)
        hidden = self._path(f"{target.getParent().toString()}/.{target.getName()}.{uuid.uuid4().hex}")
        self._written(hidden, text)
        faults.hit("publish")
        try:
            return self._named(hidden, target)
        finally:
            self._fs.delete(hidden, False)

    def _written(self, path, text: str) -> bool:
        try:
            stream = self._fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def _named(self, hidden, target) -> bool:
        gateway = self.spark.sparkContext._gateway
        try:
            if self._fs.getScheme() == "file":
                local = lambda p: self._jvm.java.nio.file.Paths.get(self._fs.makeQualified(p).toUri())
                self._jvm.java.nio.file.Files.createLink(local(target), local(hidden))
            else:
                rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                options = gateway.new_array(rename, 1)
                options[0] = rename.NONE
                context.rename(self._fs.makeQualified(hidden), self._fs.makeQualified(target), options)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._path(self.at(path)), True)
