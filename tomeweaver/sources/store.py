"""Tables in shared folders, and versioned tables behind a pointer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one of our own if all of Spark runs on this machine, else an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tomeweaver-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> list:
    """Path and file system of each folder that a written table's files lie in."""
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})]
    return [(p, p.getFileSystem(spark._jsc.hadoopConfiguration())) for p in paths]


def still_written(df: DataFrame) -> bool:
    """Whether the files of a table that ``written`` has made are still there."""
    return all(fs.exists(path) for path, fs in _folders(df))


def dropped(df: DataFrame) -> None:
    """Removes a table that ``written`` has made, when nothing reads it any more."""
    for path, fs in _folders(df):
        fs.delete(path, True)


class Store:
    """Named tables under a root, each one or more folders that a pointer lists.

    A change writes new folders, then a new pointer, so readers see the old table or the new one.  A folder goes when
    neither the pointer nor the one before it lists it.  Replacing or extending a table drops the tables that derive
    from it: postings bring down terms, edges and ranks, and edges bring down ranks.
    """

    DERIVED = {"postings": ["terms", "edges", "edges_state", "ranks", "ranks_state"], "edges": ["ranks", "ranks_state"]}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def _listed(self, name: str, pointer: str) -> list[str]:
        stream = self.fs.open(self._path(name, pointer))
        try:
            return [x for x in bytes(stream.readAllBytes()).decode().split("\n") if x]
        finally:
            stream.close()

    def folders(self, name: str) -> list[str]:
        pointers = [n for n in self._names(name) if n.startswith("current-")]
        return self._listed(name, pointers[-1]) if pointers else []

    def _point(self, name: str, folders: list[str]) -> None:
        old = [n for n in self._names(name) if n.startswith("current-")]
        n = 1 + (int(old[-1].split("-")[1]) if old else 0)
        out = self.fs.create(self._path(name, f"current-{n:012d}"))
        out.write("\n".join(folders).encode())
        out.close()
        kept = {*folders, *(self._listed(name, old[-1]) if old else [])}
        for x in old[:-1]:
            self.fs.delete(self._path(name, x), False)
        for x in self._names(name):
            if x.startswith("v-") and x not in kept:
                self.fs.delete(self._path(name, x), True)
        for d in self.DERIVED.get(name, []):
            self.drop(d)

    def replace(self, name: str, df: DataFrame) -> None:
        v = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{v}")
        self._point(name, [v])

    def append(self, name: str, df: DataFrame) -> None:
        v = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{v}")
        self._point(name, [*self.folders(name), v])

    def drop(self, name: str) -> None:
        """Takes the pointers away; the folders go with the next change."""
        for x in self._names(name):
            if x.startswith("current-"):
                self.fs.delete(self._path(name, x), False)

    def read(self, name: str) -> DataFrame | None:
        found = self.folders(name)
        return self.spark.read.parquet(*(f"{self.root}/{name}/{v}" for v in found)) if found else None
