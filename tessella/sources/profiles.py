"""Profiles: named sets of tables, from files, catalogs or databases."""

from __future__ import annotations

import os
import re
import urllib.error
import urllib.request
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import BackendError, DefinitionError

_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}|\$([A-Za-z_][A-Za-z0-9_]*)")
MOST_YAML = 10 << 20
FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".orc": "orc", ".avro": "avro", ".txt": "text"}


def expanded(value: Any) -> Any:
    """Values with ${NAME} and ${NAME:-default} from the environment; an unset name without default is an error."""
    if isinstance(value, str):

        def put(m: re.Match) -> str:
            name = m[1] or m[3]
            if name in os.environ:
                return os.environ[name]
            if m[2] is not None:
                return m[2]
            raise DefinitionError(f"the environment has no {name}")

        return _VARIABLE.sub(put, value)
    if isinstance(value, Mapping):
        return {k: expanded(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v) for v in value]
    return value


def read_yaml(path: str | Path) -> dict[str, Any]:
    import yaml

    try:
        if str(path).startswith(("http://", "https://")):
            with urllib.request.urlopen(str(path), timeout=30) as f:
                got = yaml.safe_load(f.read(MOST_YAML + 1)[:MOST_YAML].decode("utf-8"))
        else:
            with open(path, encoding="utf-8") as f:
                got = yaml.safe_load(f)
    except FileNotFoundError as e:
        raise DefinitionError(f"no file {str(path)!r}") from e
    except (urllib.error.URLError, TimeoutError) as e:
        raise DefinitionError(f"{str(path)!r} can't be read: {e}") from e
    except yaml.YAMLError as e:
        raise DefinitionError(f"{str(path)!r} isn't YAML: {e}") from e
    if not isinstance(got, dict):
        raise DefinitionError(f"{str(path)!r} must hold a mapping")
    return got


class Connection:
    """Tables by name: named files first, then the catalog (or a database of it), or a JDBC source."""

    def __init__(self, spark: SparkSession, profile: Mapping[str, Any] | None = None, base: str | Path = "."):
        self.spark, self.profile, self.base = spark, expanded(dict(profile or {})), Path(base)
        self.kind = self.profile.get("type", "spark")
        if self.kind not in ("spark", "files", "jdbc"):
            raise DefinitionError(f"unknown profile type {self.kind!r}; known: spark, files, jdbc")
        for k, v in (self.profile.get("conf") or {}).items():
            spark.conf.set(k, v)

    def list_tables(self) -> list[str]:
        named = list(self.profile.get("tables") or {})
        if folder := self.profile.get("path"):
            named += sorted(n.split(".")[0] for n in self._names(folder) if Path(n).suffix in FORMATS)
        if not named and self.kind == "spark":
            named = [t.name for t in self.spark.catalog.listTables(self.profile.get("database"))]
        return list(dict.fromkeys(named))

    def _at(self, path: str) -> str:
        """A path relative to the profile's file; URIs stay as they are."""
        return path if "://" in path or Path(path).is_absolute() else str(self.base / path)

    def _names(self, folder: str) -> list[str]:
        """What lies in a folder, of this machine or of any file system that Spark knows."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self._at(folder))
        try:
            return [s.getPath().getName() for s in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)]
        except Exception as e:
            raise BackendError(f"folder {folder!r} can't be listed: {str(e).splitlines()[0]}") from e

    def table(self, name: str, database: str | list[str] | None = None) -> DataFrame:
        tables = self.profile.get("tables") or {}
        try:
            if name in tables and database is None:
                return self._read(tables[name])
            if database is None and (folder := self.profile.get("path")):
                there = set(self._names(folder))
                for suffix in FORMATS:
                    if f"{name}{suffix}" in there:
                        return self._read(f"{self._at(folder).rstrip('/')}/{name}{suffix}")
            if self.kind == "jdbc":
                return self.spark.read.format("jdbc").options(**self.profile.get("options", {})).option("dbtable", name).load()
            parts = [database] if isinstance(database, str) else list(database or ([self.profile["database"]] if self.profile.get("database") else []))
            return self.spark.table(".".join(f"`{p}`" for x in [*parts, name] for p in str(x).split(".")))
        except DefinitionError:
            raise
        except Exception as e:
            raise BackendError(f"table {name!r} can't be read: {str(e).splitlines()[0]}") from e

    def _read(self, spec: Any) -> DataFrame:
        if isinstance(spec, str):
            spec = {"source": spec}
        source = spec.get("source") or spec.get("path")
        if not source:
            raise DefinitionError("a table needs a source")
        kind = spec.get("format") or next((f for s, f in FORMATS.items() if str(source).rstrip("/").endswith(s)), "parquet")
        reader = self.spark.read.format(kind).options(**{"header": "true"} if kind == "csv" else {}).options(**spec.get("options", {}))
        if spec.get("schema"):
            reader = reader.schema(spec["schema"])
        return reader.load(self._at(str(source)))


def get_connection(spark: SparkSession, profile: str | Mapping[str, Any] | Connection | None = None, profile_file: str | Path | None = None) -> Connection:
    """The connection of a profile: a mapping, or a name in profile_file or ./profiles.yml; without a name its only or default one."""
    if isinstance(profile, Connection):
        return profile
    if isinstance(profile, Mapping):
        return Connection(spark, profile)
    path = Path(profile_file) if profile_file else Path("profiles.yml")
    if profile is None and profile_file is None and not path.exists():
        return Connection(spark)
    known = read_yaml(path)
    if profile is None:
        if len(known) != 1 and "default" not in known:
            raise DefinitionError(f"name a profile: {', '.join(known)}")
        profile = "default" if "default" in known else next(iter(known))
    if profile not in known:
        raise DefinitionError(f"no profile {profile!r} in {str(path)!r}; known: {', '.join(known)}")
    return Connection(spark, known[profile], path.parent)
