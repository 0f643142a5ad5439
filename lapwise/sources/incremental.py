"""Tables derived session by session, brought up to date by the sessions whose source files changed.

A manifest remembers, for every session, a digest of its source files' names, lengths and times, and the run that
derived it.  A refresh lists the files (their content is not read), builds the sessions whose digest is new with a
partition filter on the sources, writes them by dynamic partition overwrite, and publishes a new manifest last.  Rows
carry the run that wrote them, and a reader takes a session's rows only from the run the manifest names, so a
refresh that stops half-way shows no half-written session, and the next one does its work again.

Sessions are races of the calendar, a few dozen a season however many laps they have, so the manifest is held
on the driver.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwise import schemas
from lapwise.sources.tables import in_sessions, write_sessions

RUN = "_run"
Session = tuple[int, int]


@dataclass(frozen=True)
class Source:
    """A table partitioned by session: its folder and how to read it."""

    path: str
    read: Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Refresh:
    built: list[Session]
    removed: list[Session]


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Year, RoundNumber and a digest of the session's files: names, lengths and times, not content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    described = F.concat_ws(":", F.element_at(F.split("path", "/"), -1), "length", F.unix_micros("modificationTime"))
    return files.groupBy(*schemas.SESSION).agg(F.md5(F.concat_ws(",", F.sort_array(F.collect_list(described)))).alias("digest"))


class SessionTable:
    """A derived table in ``folder``.

    ``build`` makes it from the sources' tables, cut to the sessions wanted; its rows have Year and RoundNumber and each
    depends on its own session alone.  ``version`` stands for all else that rows depend on: another one
    builds every session anew.
    """

    def __init__(self, spark: SparkSession, folder: str, build: Callable[..., DataFrame], version: str = "") -> None:
        self.spark, self.build, self.version = spark, build, version
        self.data, self.manifests = f"{folder}/data", f"{folder}/manifests"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _runs(self) -> list[int]:
        """Published runs: those whose manifest is whole."""
        found = self._files.globStatus(self._path(f"{self.manifests}/*/_SUCCESS")) or []
        return sorted(int(status.getPath().getParent().getName()) for status in found)

    def manifest(self) -> dict[Session, tuple[str, int]]:
        """Digest and run of every session in the table."""
        runs = self._runs()
        if not runs:
            return {}
        rows = self.spark.read.parquet(f"{self.manifests}/{runs[-1]}").collect()
        return {(r["Year"], r["RoundNumber"]): (r["digest"], r["run"]) for r in rows}

    def _current(self, sources: dict[str, Source]) -> dict[Session, str]:
        parts = [
            file_digests(self.spark, source.path).withColumn("digest", F.concat_ws("=", F.lit(name), "digest"))
            for name, source in sorted(sources.items())
        ]
        listed = parts[0]
        for part in parts[1:]:
            listed = listed.unionByName(part)
        whole = F.concat_ws(";", F.lit(self.version), F.sort_array(F.collect_list("digest")))
        rows = listed.groupBy(*schemas.SESSION).agg(whole.alias("digest")).collect()
        return {(r["Year"], r["RoundNumber"]): r["digest"] for r in rows}

    def _sessions(self, sessions: list[Session]) -> DataFrame:
        return self.spark.createDataFrame(sessions, "Year int, RoundNumber int")

    def refresh(self, sources: dict[str, Source]) -> Refresh:
        """Builds new and changed sessions and forgets removed ones."""
        known, current = self.manifest(), self._current(sources)
        built = sorted(s for s, digest in current.items() if known.get(s, (None,))[0] != digest)
        removed = sorted(known.keys() - current.keys())
        if not built and not removed:
            return Refresh([], [])
        run = max(self._runs(), default=0) + 1
        if built:
            wanted = in_sessions(self._sessions(built))
            cut = {name: source.read(self.spark, source.path).where(wanted) for name, source in sources.items()}
            write_sessions(self.build(**cut).withColumn(RUN, F.lit(run)), self.data, only_present=True)
        kept = {s: known[s][1] for s in current if s not in set(built)}
        rows = [(*s, digest, kept.get(s, run), run) for s, digest in sorted(current.items())]
        manifest = self.spark.createDataFrame(rows, "Year int, RoundNumber int, digest string, run int, published int")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.manifests}/{run}")
        for year, number in removed:  # nothing names them any more
            self._files.delete(self._path(f"{self.data}/Year={year}/RoundNumber={number}"), True)
        for old in self._runs()[:-2]:
            self._files.delete(self._path(f"{self.manifests}/{old}"), True)
        return Refresh(built, removed)

    def read(self) -> DataFrame:
        """The table as the last published run left it."""
        runs: dict[int, list[Session]] = {}
        for session, (_, run) in self.manifest().items():
            runs.setdefault(run, []).append(session)
        if not runs:
            raise FileNotFoundError(f"no run was published in {self.manifests}; refresh first")
        # Sessions without a row have no partition, and a run may have none at all.
        rows = self.spark.read.parquet(self.data)
        valid = F.lit(False)
        for run, sessions in runs.items():
            valid |= (F.col(RUN) == run) & in_sessions(self._sessions(sessions))
        return rows.where(valid).drop(RUN)
