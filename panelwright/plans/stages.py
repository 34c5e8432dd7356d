"""A stage cache: Parquet artifacts keyed by digests that chain every earlier stage's specification."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import platform
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, is_dataclass
from typing import Any

import pyspark
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


def canonical(x: Any) -> str:
    """JSON with sorted keys, the same for equal specifications."""

    def plain(v):
        if is_dataclass(v) and not isinstance(v, type):
            return {"_": type(v).__name__, **asdict(v)}
        if isinstance(v, set | frozenset):
            return sorted(v)
        return v.isoformat() if hasattr(v, "isoformat") else str(v)

    return json.dumps(x, sort_keys=True, default=plain, separators=(",", ":"))


def digest(*parts: Any) -> str:
    return hashlib.sha256("\x1e".join(canonical(p) for p in parts).encode()).hexdigest()


def source_identity(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(file, size, modification time) below a path, by the cluster's own file system."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out, walk = [], fs.listFiles(at, True)
    while walk.hasNext():
        f = walk.next()
        out.append((f.getPath().toUri().getPath(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def stage_key(spec: Any, upstream: str = "", sources: Any = ()) -> str:
    return digest(spec, upstream, sources, {"spark": pyspark.__version__, "python": platform.python_version_tuple()[:2]})


@dataclass(frozen=True)
class Stage:
    label: str
    key: str
    run: Callable[[DataFrame | None], DataFrame]


class StageCache:
    """Artifacts below ``root``. Data go to a fresh folder that the manifest, written last, names: a run that dies halfway
    leaves the artifact of before, or none. What is unreadable is a miss; a failed write is logged and the run goes on."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, key: str) -> str:
        return f"{self.root}/{key[:2]}/{key}"

    def load(self, key: str) -> DataFrame | None:
        try:
            notes = [json.loads(r.value) for r in self.spark.read.text(f"{self._path(key)}.manifests/*").collect()]  # a line a write
            if not notes:
                return None
            return self.spark.read.parquet(f"{self._path(key)}-{max(notes, key=lambda n: n['at'])['data']}")
        except (PySparkException, Py4JError, OSError, ValueError, KeyError) as e:
            log.debug("no artifact %s: %s", key, e)
            return None

    def store(self, key: str, df: DataFrame, label: str) -> DataFrame:
        name = uuid.uuid4().hex
        note = json.dumps({"label": label, "key": key, "columns": df.columns, "data": name, "at": time.time()})
        try:
            df.write.parquet(f"{self._path(key)}-{name}")
            self.spark.createDataFrame([(note,)], "value string").coalesce(1).write.text(f"{self._path(key)}.manifests/{name}")
            return self.spark.read.parquet(f"{self._path(key)}-{name}")
        except (PySparkException, Py4JError, OSError) as e:
            log.warning("stage %s isn't kept: %s", label, e)
            return df


def resolve(stages: Sequence[Stage], cache: StageCache | None) -> DataFrame:
    """Resume after the deepest artifact there is; keep what the rest of the stages make; refuse an empty stage."""
    at, df = 0, None
    if cache:
        for k in range(len(stages) - 1, -1, -1):
            if (df := cache.load(stages[k].key)) is not None:
                log.info("resuming after %s", stages[k].label)
                at = k + 1
                break
    for s in stages[at:]:
        df = s.run(df)
        if cache:
            df = cache.store(s.key, df, s.label)
            if df.isEmpty():
                raise ValueError(f"stage {s.label} made no rows")
    return df


def git_identity(folder: str = ".") -> dict[str, str]:
    import subprocess

    ask = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=False).stdout.strip()
    return {"commit": ask("rev-parse", "HEAD"), "dirty": str(bool(ask("status", "--porcelain"))), "user": os.environ.get("USER", "")}
