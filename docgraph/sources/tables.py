"""Sets of tables that change together: data in numbered pieces, and manifests that say which pieces count.

A commit writes its new pieces first and its manifest last; a manifest counts once Spark has marked it complete. Readers
take the last complete one, so that they see all tables of a commit or none of it, and a writer that is killed on
the way leaves what was there. Pieces are never changed: a commit adds some, replaces a table by new ones, or both.
One writer at a time; readers need no lock. Paths are those of Spark, on any file system it can reach.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgraph.operators.history import fold, push_history

#: One row for each piece that counts; its schema is kept, so that reading needs no look at the files.
MANIFEST = "table string, piece string, schema string, partitions string"
PACKAGE = ["package", "version"]


class TableSet:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _listed(self, pattern: str) -> list[str]:
        p, fs = self._fs(f"{self.path}/{pattern}")
        return [s.getPath().toString() for s in (fs.globStatus(p) or [])]

    def numbers(self) -> list[int]:
        """Complete commits, oldest first."""
        return sorted(int(p.split("/")[-2]) for p in self._listed("manifests/*/_SUCCESS"))

    def pieces(self, number: int | None = None) -> list[dict]:
        """The pieces of a commit (of the last one by default); the driver holds one small row for each."""
        known = self.numbers()
        if number is None:
            if not known:
                return []
            number = known[-1]
        elif number not in known:
            raise ValueError(f"no complete commit {number}")
        return [r.asDict() for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{number:010d}").collect()]

    def table(self, name: str, number: int | None = None) -> DataFrame | None:
        """A table of a commit, None if it has none. ``piece`` is the commit that wrote a row's piece."""
        found = [p for p in self.pieces(number) if p["table"] == name]
        if not found:
            return None
        schema = T.StructType.fromJson(json.loads(found[-1]["schema"]))
        whole = T.StructType([*schema.fields, T.StructField("piece", T.IntegerType())])
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/data/{name}").parquet(*[f"{self.path}/data/{name}/{p['piece']}" for p in found])

    def commit(self, added: dict[str, DataFrame], replaced: Iterable[str] = (), partition_by: Iterable[str] = ()) -> int:
        """Writes the tables as pieces of a new commit and returns its number. Pieces of the last commit stay, but for those
        of the tables in ``replaced``."""
        replaced, parts = set(replaced), list(partition_by)
        kept = [p for p in self.pieces() if p["table"] not in replaced]
        # numbers of commits that were broken off are not used again
        tried = [int(p.rsplit("=", 1)[1]) for p in self._listed("data/*/piece=*")] + self.numbers()
        number = max(tried, default=-1) + 1
        for name, frame in added.items():
            by = [c for c in parts if c in frame.columns]
            by = by if len(by) < len(frame.columns) else []
            writer = frame.write.partitionBy(*by) if by else frame.write
            writer.parquet(f"{self.path}/data/{name}/piece={number}")
            ordered = [f for f in frame.schema.fields if f.name not in by] + [frame.schema[c] for c in by]
            kept.append({"table": name, "piece": f"piece={number}", "schema": T.StructType([T.StructField(f.name, f.dataType) for f in ordered]).json(), "partitions": ",".join(by)})
        rows = [tuple(p[c] for c in ("table", "piece", "schema", "partitions")) for p in kept]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifests/{number:010d}")
        return number

    def compact(self, name: str, partition_by: Iterable[str] = ()) -> int:
        """Rewrites the pieces of a table as one."""
        return self.commit({name: self.table(name).drop("piece")}, replaced=[name], partition_by=partition_by)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last ``keep`` manifests and the pieces that none of those counts; the number of pieces."""
        known = self.numbers()
        last = known[-keep:]
        used = {(p["table"], p["piece"]) for n in last for p in self.pieces(n)}
        for n in known[:-keep]:
            p, fs = self._fs(f"{self.path}/manifests/{n:010d}")
            fs.delete(p, True)
        gone = 0
        for path in self._listed("data/*/piece=*"):
            if tuple(path.split("/")[-2:]) not in used:
                p, fs = self._fs(path)
                gone += bool(fs.delete(p, True))
        return gone


class GraphStore(TableSet):
    """Compiled tables of packages, each with package and version columns, partitioned by them.

    A package at a version that is compiled again counts by its last piece, in all tables at once.
    """

    def compiled(self) -> DataFrame:
        """(package, version, piece): the piece of each package and version that counts."""
        done = self.table("compiled")
        if done is None:
            return self.spark.createDataFrame([], "package string, version string, piece int")
        return done.groupBy(*PACKAGE).agg(F.max("piece").alias("piece"))

    def write(self, tables: dict[str, DataFrame], packages: DataFrame) -> int:
        """Adds the tables of ``packages`` (package, version; those without rows count as compiled too)."""
        return self.commit({**tables, "compiled": packages.select(*PACKAGE).distinct()}, partition_by=PACKAGE)

    def read(self, name: str) -> DataFrame | None:
        """A table over all compiled packages and versions; filters on them prune folders."""
        rows = self.table(name)
        return None if rows is None else rows.join(self.compiled(), [*PACKAGE, "piece"], "left_semi").drop("piece")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The (package, version) of ``wanted`` that are not compiled."""
        return wanted.select(*PACKAGE).distinct().join(self.compiled(), PACKAGE, "left_anti")

    def ensure(self, wanted: DataFrame, compile: Callable[[DataFrame], dict[str, DataFrame]]) -> int:
        """Compiles what of ``wanted`` (package, version) is missing, and only that; how many packages that were.

        ``compile`` gets the missing ones and returns their tables.
        """
        lacking = self.missing(wanted).persist()
        n = lacking.count()
        if n:
            self.write(compile(lacking), lacking)
        lacking.unpersist()
        return n


class HistoryStore(TableSet):
    """Keyframes of a history that grows by pushes: closed ones are added and never read again by a push, open ones (those
    that reach the last version) are replaced. A push costs what the open keyframes and its own rows do."""

    def __init__(self, spark: SparkSession, path: str, entity: list[str], value: str = "value") -> None:
        super().__init__(spark, path)
        self.entity, self.value = entity, value

    def last(self) -> int | None:
        done = self.table("pushed")
        return None if done is None else done.agg(F.max("ver")).first()[0]

    def push(self, observations: DataFrame) -> int | None:
        """Folds in (entity, ver, value) of one or more versions after the last; the last version then.

        Each entity is observed once a version at most. Versions that were pushed before are an error.
        """
        span = observations.agg(F.min("ver"), F.max("ver")).first()
        last = self.last()
        if span[0] is None:
            return last
        if last is not None and span[0] <= last:
            raise ValueError(f"version {span[0]} is not after {last}")
        frames = push_history(observations.select(*self.entity, "ver", self.value), self.entity, value=self.value)
        before = self.table("open")
        if before is not None:
            frames = fold(before.drop("piece").unionByName(frames), self.entity, self.value)
        frames = frames.persist()
        reaches = F.col("hi") == span[1]
        pushed = self.spark.createDataFrame([(span[1],)], "ver int")
        self.commit({"closed": frames.filter(~reaches), "open": frames.filter(reaches), "pushed": pushed}, replaced=["open", "pushed"])
        frames.unpersist()
        return span[1]

    def keyframes(self) -> DataFrame | None:
        """(entity, lo, hi, value): all keyframes."""
        closed, opened = self.table("closed"), self.table("open")
        return None if closed is None else closed.unionByName(opened).drop("piece")
