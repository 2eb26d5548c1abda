"""A versioned catalog of tables in one YAML or JSON manifest: digests, upstream lineage, and its validation."""

from __future__ import annotations

import functools
import json
import re
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .digest import digest
from .layout import read_csv
from .paths import URL, local_or_s3, read_text, spark_path, text_exists, write_text

NAME = re.compile(r"[0-9A-Za-z_-]+")
VERSION = re.compile(r"[0-9A-Za-z.-]+")


class LineageError(Exception):
    """A recorded digest differs from the one that a downstream table was made from."""


def parse_version(version: str) -> tuple[tuple[int, int | str], ...]:
    """Comparable parts: numbers by value, and before texts."""
    return tuple((0, int(p)) if p.isdecimal() else (1, p) for p in version.split("."))


def version_name(name: str, version: str) -> str:
    return f"{name}_{version}"


def version_and_name(text: str) -> tuple[str, str]:
    """(version, name) of a version name."""
    name, found, version = text.rpartition("_")
    if not found or not name:
        raise ValueError(f"{text!r} is no version name")
    return version, name


def validate_version(version: str) -> str:
    if not VERSION.fullmatch(version):
        raise ValueError("versions consist of letters, digits, '-' and '.'")
    return version


@dataclass(frozen=True)
class Source:
    """A record of the catalog. upstream: (version name, digest) pairs."""

    name: str
    version: str = ""
    path: str = ""
    digest: str | None = None
    upstream: tuple[tuple[str, str | None], ...] = ()
    format: str = "parquet"
    metadata: dict = field(default_factory=dict, hash=False, compare=False)

    def __post_init__(self) -> None:
        if not NAME.fullmatch(self.name):
            raise ValueError("names consist of letters, digits, '-' and '_'")
        if self.version:
            validate_version(self.version)
        object.__setattr__(self, "upstream", tuple(tuple(u) for u in self.upstream))

    def __eq__(self, other) -> bool:
        return isinstance(other, Source) and (self.name, self.version, self.digest, self.upstream) == (other.name, other.version, other.digest, other.upstream)

    __hash__ = object.__hash__

    @property
    def key(self) -> str:
        return version_name(self.name, self.version) if self.version else self.name

    def read(self, spark: SparkSession) -> DataFrame:
        return read_csv(spark, self.path) if self.format == "csv" else spark.read.format(self.format).load(spark_path(self.path))

    def with_digest(self, value: str | None) -> Source:
        return Source(**{**asdict(self), "digest": value})

    def export(self, spark: SparkSession, path, **options) -> Source:
        """A copy of the table under path, whose metadata tell where it came from."""
        self.read(spark).write.options(**options).parquet(spark_path(path))
        return Source(self.name, self.version, str(path), self.digest, self.upstream, metadata={**self.metadata, "exported_from": self.path, "exported_at": time.time(), "options": options})


class Catalog:
    """The records in one manifest file, local or in a shared store. Every change is written to a new file that then takes the old one's place."""

    def __init__(self, file: str | Path | URL, spark: SparkSession | None = None):
        self.file, self._spark = local_or_s3(file), spark
        self.records: dict[str, Source] = {}
        self.reload() if text_exists(self.file, spark or isinstance(self.file, URL) and self.spark) else self._write()

    @property
    def spark(self) -> SparkSession:
        return self._spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    def reload(self) -> Catalog:
        text = read_text(self.file, isinstance(self.file, URL) and self.spark)
        found = (json.loads(text) if self.file.suffix == ".json" else _yaml().safe_load(text)) or {}
        self.records = {k: Source(**r) for k, r in (found.get("sources") or {}).items()}
        return self

    def _write(self) -> None:
        plain = {"sources": {k: {**asdict(r), "upstream": [list(u) for u in r.upstream]} for k, r in self.records.items()}}
        text = json.dumps(plain, indent=1) if self.file.suffix == ".json" else _yaml().safe_dump(plain, sort_keys=False)
        write_text(self.file, text, isinstance(self.file, URL) and self.spark)

    def append(self, source: Source) -> Source:
        """Adds or replaces the record of this name and version."""
        if text_exists(self.file, isinstance(self.file, URL) and self.spark):
            self.reload()
        self.records[source.key] = source
        self._write()
        return source

    def __contains__(self, key: str) -> bool:
        return key in self.records

    def __iter__(self):
        return iter(self.records)

    def find(self, key: str, expected: str | None = None, check: bool = True, _above: tuple[str, ...] = ()) -> Source:
        """The record of a version name; its whole lineage must be there with the recorded digests."""
        if key not in self.records:
            raise KeyError(key)
        if key in _above:
            raise LineageError(f"{key} is upstream of itself")
        source = self.records[key]
        if expected is not None and source.digest != expected:
            raise LineageError(f"{key} has digest {source.digest}, but {expected} was recorded downstream")
        if check and source.version:
            version, name = version_and_name(key)
            if (version, name) != (source.version, source.name):
                raise LineageError(f"{key} is recorded as {source.key}")
        for up, recorded in source.upstream if check else ():
            self.find(up, recorded, _above=(*_above, key))
        return source

    def find_version(self, name: str, version: str) -> Source:
        return self.find(version_name(name, version))

    def latest(self, name: str) -> Source:
        """The highest version of name, parts compared as numbers."""
        own = [r for r in self.records.values() if r.name == name and r.version]
        if not own:
            raise KeyError(name)
        return self.find(max(own, key=lambda r: parse_version(r.version)).key)

    def __getitem__(self, key: str | Source) -> Source:
        if isinstance(key, Source):
            return self.find(key.key)
        return self.find(key) if key in self.records else self.latest(key)

    def validate(self, deep: bool = False) -> tuple[bool, dict[str, list[tuple[str, bool]]]]:
        """(whether all is well, for each versioned record its upstreams and itself with their state). An upstream that is missing, differs or is itself
        bad makes its record bad. deep: the tables are read and hashed again."""
        state: dict[str, list[tuple[str, bool]]] = {}

        def good(key: str, above: tuple[str, ...]) -> bool:
            if key not in self.records or key in above:
                return False
            if key not in state:
                source = self.records[key]
                rows = [(up, up in self.records and self.records[up].digest == recorded and good(up, (*above, key))) for up, recorded in source.upstream]
                own = source.key == key and all(ok for _, ok in rows) and (not deep or digest(source.read(self.spark)) == source.digest)
                state[key] = [*rows, (key, own)]
            return state[key][-1][1]

        every = [good(k, ()) for k, r in self.records.items() if r.version]
        return all(every), state

    def dump(self, df: DataFrame, name: str, path, compute: bool = True, **options) -> tuple[Source, Callable[[], Source]]:
        """Writes df under path/name and records it without version. compute=False: neither happens before the function that comes back is called."""
        source = Source(name, path=str(local_or_s3(path) / name))

        def job() -> Source:
            df.write.mode("overwrite").options(**options).parquet(spark_path(source.path))
            return self.append(source)

        if compute:
            job()
            return source, lambda: source
        return source, job

    def dump_pandas(self, frame, name: str, path, partitions: int = 1, **options) -> tuple[Source, Callable[[], Source]]:
        return self.dump(self.spark.createDataFrame(frame).repartition(partitions), name, path, **options)

    def publish(self, df: DataFrame, name: str, version: str, folder, upstream: Sequence[Source] = (), metadata: dict | None = None, **options) -> Source:
        """Writes df under folder/name/version, reads it back, hashes it and records it with its lineage."""
        path = str(local_or_s3(folder) / name / version)
        source = Source(name, version, path, upstream=tuple((u.key, u.digest) for u in upstream), metadata=metadata or {})
        df.write.mode("overwrite").options(**options).parquet(spark_path(path))
        return self.append(source.with_digest(digest(df.sparkSession.read.parquet(spark_path(path)))))

    def publish_pandas(self, frame, name: str, version: str, folder, upstream: Sequence[Source] = (), **options) -> Source:
        return self.publish(self.spark.createDataFrame(frame), name, version, folder, upstream, **options)

    def analysis(self, name: str, version: str, sources: Sequence[str], folder) -> Callable:
        """Decorates a function of DataFrames, named as the sources, so that a call publishes its result with them as lineage."""

        def decorate(function: Callable[..., DataFrame]) -> Callable[..., Source]:
            @functools.wraps(function)
            def run(*args, **kwargs) -> Source:
                found = [self[s] for s in sources]
                names = [s.name for s in found]
                if len(set(names)) < len(names):
                    raise ValueError("two sources have one name")
                return self.publish(function(*args, **kwargs, **{s.name: s.read(self.spark) for s in found}), name, version, folder, found)

            return run

        return decorate


def _yaml():
    import yaml

    return yaml
