"""Local paths, s3 URLs and those of other shared stores behind one small interface; and small text files in any of them."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path
from urllib.parse import urlsplit


class URL(str):
    """A URL with the parts of pathlib's interface that data folders need."""

    def __truediv__(self, part) -> URL:
        return type(self)(f"{self.rstrip('/')}/{part}")

    @property
    def suffix(self) -> str:
        return Path(urlsplit(self).path).suffix

    def mkdir(self, **_) -> None:
        """Nothing: object stores have no folders, and others make them with their files."""


class S3URL(URL):
    """An s3:// URL."""

    def __new__(cls, text: str) -> S3URL:
        return super().__new__(cls, text if text.startswith("s3://") else f"s3://{text}")

    def bucket(self) -> str:
        return urlsplit(self).netloc

    def key(self) -> str:
        return urlsplit(self).path.lstrip("/")


def local_or_s3(path: str | Path | URL) -> Path | URL:
    if isinstance(path, (Path, URL)):
        return path
    return S3URL(path) if path.startswith("s3://") else URL(path) if "://" in path else Path(path)


def _hadoop(spark, path: URL):
    """(file system, path) as Spark's own readers see them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(spark_path(path))
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def text_exists(path: Path | URL, spark) -> bool:
    if isinstance(path, Path):
        return path.exists()
    system, where = _hadoop(spark, path)
    return system.exists(where)


def read_text(path: Path | URL, spark) -> str:
    if isinstance(path, Path):
        return path.read_text()
    system, where = _hadoop(spark, path)
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: Path | URL, text: str, spark) -> None:
    """A new file that then takes the old one's place. Object stores show a file only when it is whole, so there the new one is written in place."""
    if isinstance(path, Path):
        path.parent.mkdir(parents=True, exist_ok=True)
        handle, new = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
        with os.fdopen(handle, "w") as out:
            out.write(text)
        os.replace(new, path)
        return
    system, where = _hadoop(spark, path)
    whole = isinstance(path, S3URL)
    new = where if whole else where.suffix(".new")
    stream = system.create(new, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not whole:
        rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
        how = spark._sc._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration()).rename(new, where, how)


def spark_path(path: str | Path | URL) -> str:
    """As Spark's readers and writers want it: s3a:// for s3://."""
    text = str(path)
    return "s3a://" + text.removeprefix("s3://") if text.startswith("s3://") else text
