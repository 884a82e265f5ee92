"""A folder on any file system that Spark knows, and files that only one writer can make."""

from __future__ import annotations

import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Seconds after which the claim of a writer on a file counts as left behind.
CLAIM_S = 60.0


class Folder:
    """Names are relative to the folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def uri(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def make(self, *parts: str) -> None:
        for part in parts:
            self.fs.mkdirs(self.path(part))

    def statuses(self, part: str) -> list:
        return list(self.fs.listStatus(self.path(part)))

    def names(self, part: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.statuses(part))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def rename(self, name: str, to: str) -> bool:
        return self.fs.rename(self.path(name), self.path(to))

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
            stream.hsync()
        finally:
            stream.close()

    def replace(self, name: str, to: str) -> None:
        """Renames over what is there, in one step where the file system has one."""
        options = self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        qualified = [self.fs.makeQualified(self.path(n)) for n in (name, to)]
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified[0].toUri(), self.spark._jsc.hadoopConfiguration()).rename(*qualified, options)

    def publish(self, name: str, text: str) -> bool:
        """Makes a file that appears whole, or not at all; False if another writer made it or is about to.

        The text goes to a temporary file, which is renamed under a claim: creating the claim fails for all but one
        writer, so it does not matter whether the file system's rename would overwrite.
        """
        above, _, last = name.rpartition("/")
        temporary, claim = f"{above}/.{last.split('.')[0]}-{uuid.uuid4().hex}.tmp", f"{above}/.{last.split('.')[0]}.claim"
        self.write_text(temporary, text)
        if self.exists(name) or not self._claim(claim, name):
            self.delete(temporary)
            return False
        try:
            if not self.rename(temporary, name):
                if self.exists(name):
                    return False
                raise OSError(f"{name} can't be written")
        finally:
            self.delete(claim)
        return True

    def _create(self, name: str) -> None:
        """An empty file that must not exist yet.  Hadoop's local file system looks first and makes it then; the machine's own doesn't."""
        if self.fs.getUri().getScheme() == "file":
            os.close(os.open(self.path(name).toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        else:
            self.fs.create(self.path(name), False).close()

    def _claim(self, claim: str, target: str) -> bool:
        """Whether this writer may make the target.  The claim of a writer that died is broken once it is CLAIM_S old."""
        for _ in range(2):
            try:
                self._create(claim)
                if not self.exists(target):
                    return True
                self.delete(claim)
                return False
            except (Py4JJavaError, FileExistsError):
                try:
                    age = time.time() - self.fs.getFileStatus(self.path(claim)).getModificationTime() / 1000
                except Py4JJavaError:
                    continue  # its writer is done
                if age < CLAIM_S or self.exists(target):
                    return False
                self.delete(claim)
        return False
