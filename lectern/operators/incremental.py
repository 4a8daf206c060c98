"""Processing only new or changed records.

Runs are numbered by a monotonic commit sequence. A step takes the runs above the last committed
watermark up to a bound that is fixed when the step starts (the last run before which every run has ended), and
publishes its output, its state (the last processed version of every file) and the new watermark by one
rename that replaces nothing. A step that dies before the rename leaves nothing that a reader would see; the next
one starts at the same watermark. A step that has been committed is never repeated.

The state lies in buckets by the hash of a file. A step reads and rewrites only the buckets of the files that
its runs list; the manifest points at the current folder of each bucket. Rows that arrive for a run that has been
taken up already are refused (`LateRows`): a step counts the rows up to its watermark and compares.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE = ("device", "path")
STAMP = ("size", "mtime", "hash", "modified_ns")
#: Buckets of a new store's state. A step rewrites those that its files fall into; choose by the size of the state.
STATE_BUCKETS = 32
_STATE = "run_no int, device string, path string, size bigint, mtime bigint, hash bigint, modified_ns bigint"


def same_version(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two stamps are one version (never null).

    Sizes must be equal. Two known hashes decide; otherwise the mtimes must be equal, and the
    nanosecond times too unless one is unknown. Two unknown sizes or mtimes count as equal.
    """
    hashes = a["hash"].isNotNull() & b["hash"].isNotNull()
    times = a["mtime"].eqNullSafe(b["mtime"]) & (a["modified_ns"].isNull() | b["modified_ns"].isNull() | a["modified_ns"].eqNullSafe(b["modified_ns"]))
    return a["size"].eqNullSafe(b["size"]) & F.when(hashes, a["hash"] == b["hash"]).otherwise(times)


def latest_sightings(listing: DataFrame) -> DataFrame:
    """One row per run and file, the one seen last (then the largest list_id); rows without run, device or path are not files and go.

    The aggregation combines on the map side, so a file delivered over and over does not fill one task.
    """
    known = listing.where("run_no IS NOT NULL AND device IS NOT NULL AND path IS NOT NULL")
    last = F.max_by(F.struct(*STAMP), F.struct("seen_at", "list_id")).alias("s")
    return known.groupBy("run_no", *FILE).agg(last).select("run_no", *FILE, *[F.col(f"s.{c}").alias(c) for c in STAMP])


def sightings_with_status(listing: DataFrame, runs: DataFrame, headers: DataFrame, low: int, high: int) -> DataFrame:
    """Sightings of the runs in (low, high], with ``ok`` and ``processed``.

    An ok run processes what it lists; a failed one only what it left a cache header for that fits the
    listed stamp. The bounds are pushed into both scans.
    """
    inside = f"run_no > {int(low)} AND run_no <= {int(high)}"
    status = runs.where("run_no IS NOT NULL").groupBy("run_no").agg(F.max(F.col("status") == "ok").alias("ok"))
    seen = latest_sightings(listing.where(inside)).join(status, "run_no")
    keys = ["run_no", *FILE, "size", "modified_ns"]
    kept = headers.where(inside).select(*keys).distinct().withColumn("kept", F.lit(True))
    return seen.join(kept, keys, "left").withColumn("processed", F.col("ok") | F.coalesce("kept", F.lit(False))).drop("kept")


def changed_files(sightings: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Every processed sighting with ``changed``: its version is not the last one processed before it.

    ``state`` holds the last processed version of files from before (``run_no, device, path`` and the
    stamp). After the map-side combine a file has at most one row per run, so no window is large.
    """
    rows = sightings.where("processed").select("run_no", *FILE, *STAMP, "ok", F.lit(False).alias("old"))
    if state is not None:
        rows = rows.unionByName(state.select("run_no", *FILE, *STAMP, F.lit(True).alias("ok"), F.lit(True).alias("old")))
    order = Window.partitionBy(*FILE).orderBy("run_no")
    before = F.lag(F.struct(*STAMP)).over(order)
    rows = rows.withColumn("before", before)
    same = same_version({c: F.col(c) for c in STAMP}, {c: F.col(f"before.{c}") for c in STAMP})
    return rows.withColumn("changed", F.col("before").isNull() | ~same)


def last_versions(processed: DataFrame) -> DataFrame:
    """The last processed version of every file, to be committed as the next step's state."""
    last = F.max_by(F.struct("run_no", *STAMP), "run_no").alias("s")
    return processed.groupBy(*FILE).agg(last).select("s.run_no", *FILE, *[F.col(f"s.{c}").alias(c) for c in STAMP])


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*FILE), F.lit(buckets)).cast("int")


class LateRows(RuntimeError):
    """Rows were added to runs that have been committed; start a store anew or give them a later run."""


@dataclass(frozen=True)
class Commit:
    number: int
    low: int
    high: int
    output: str
    #: Folder of each bucket of the state, and how many buckets there are.
    state: dict[str, str]
    buckets: int
    #: Rows of the listing up to ``high``.
    rows: int


class CommitStore:
    """A folder of immutable outputs and a log of manifests; what no manifest names does not exist.

    A manifest is published by a rename that fails where the target exists: atomic on file systems with atomic
    renames (HDFS, POSIX). On an object store put the log on such a file system.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = STATE_BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self._conf), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _manifest(self, name: str) -> Commit:
        fs, p = self._at(f"{self.path}/_log/{name}")
        stream = fs.open(p)
        try:
            return Commit(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def _log(self) -> list[str]:
        return [n for n in self._names("_log") if n.endswith(".json")]

    def commits(self) -> list[Commit]:
        """All manifests, for readers of the whole output; a step needs only the last."""
        return [self._manifest(n) for n in self._log()]

    def last(self) -> Commit | None:
        names = self._log()
        return self._manifest(names[-1]) if names else None

    def watermark(self, default: int = 0) -> int:
        done = self.last()
        return done.high if done else default

    def publish(self, commit: Commit) -> None:
        """The one atomic step. Fails if another process has published this number already."""
        fs, final = self._at(f"{self.path}/_log/{commit.number:010d}.json")
        _, temp = self._at(f"{self.path}/_log/.{commit.number}-{uuid.uuid4().hex}")
        fs.mkdirs(final.getParent())
        stream = fs.create(temp, True)
        try:
            stream.write(bytearray(json.dumps(commit.__dict__).encode()))
        finally:
            stream.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        keep = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        keep[0] = getattr(hadoop, "Options$Rename").NONE
        try:
            hadoop.FileContext.getFileContext(final.toUri(), self._conf).rename(temp, final, keep)
        except Exception as e:  # noqa: BLE001 - Py4J gives one class for all of Java's
            fs.delete(temp, False)
            raise RuntimeError(f"commit {commit.number} exists already; start again from its watermark") from e

    def vacuum(self, commit: Commit) -> None:
        """Remove what the newest manifest no longer needs: attempts that failed, working tables, replaced buckets."""
        current = set(commit.state.values())
        for name in self._names("data"):
            number = int(name.partition("-")[0])
            if number > commit.number:
                continue
            base = f"{self.path}/data/{name}"
            committed = self._manifest(f"{number:010d}.json").output == f"{base}/output" if number < commit.number else f"{base}/output" == commit.output
            for folder in self._names(f"data/{name}"):
                inside = [f"{base}/state/{b}" for b in self._names(f"data/{name}/state")] if folder == "state" else []
                for path in inside or [f"{base}/{folder}"]:
                    if path not in current and not (committed and folder == "output"):
                        fs, p = self._at(path)
                        fs.delete(p, True)

    def read(self) -> DataFrame | None:
        done = self.commits()
        return self.spark.read.parquet(*[c.output for c in done]) if done else None

    def state(self, touched: list[int] | None = None) -> DataFrame | None:
        """The state, or that of some buckets."""
        done = self.last()
        paths = [p for b, p in done.state.items() if touched is None or int(b) in set(touched)] if done else []
        return self.spark.read.schema(_STATE).parquet(*sorted(paths)) if paths else None


def ended_before(runs: DataFrame) -> int | None:
    """The last run up to which every run has ended: one that still goes on (no status yet) holds back those behind it."""
    got = runs.where("run_no IS NOT NULL").agg(F.max(F.when(F.col("status").isNotNull(), F.col("run_no"))), F.min(F.when(F.col("status").isNull(), F.col("run_no")))).first()
    newest, going = got[0], got[1]
    return newest if newest is None or going is None else min(newest, going - 1)


def advance(store: CommitStore, listing: DataFrame, runs: DataFrame, headers: DataFrame, upto: int | None = None, before_publish=None) -> Commit | None:
    """One step: take up the runs above the watermark up to a bound fixed now; None where there are none.

    The output has ``run_no, device, path, first`` for each file of an ok run whose version is not its
    last processed one; ``first`` tells the very first run's files, which start the index. Only rows of
    the new runs and the buckets of the state that they touch are read. ``before_publish`` is called between the
    writes and the commit (tests let it fail).
    """
    done = store.last()
    low = done.high if done else -(2**31)
    buckets = done.buckets if done else store.buckets
    newest = ended_before(runs)
    high = newest if upto is None or newest is None else min(upto, newest)
    if high is None or high <= low:
        return None
    number, attempt = done.number + 1 if done else 0, uuid.uuid4().hex
    base = f"{store.path}/data/{number:06d}-{attempt}"
    # One narrow scan of run numbers: how many rows there are up to the watermark and up to the new bound.
    counted = listing.where(f"run_no <= {int(high)}").agg(F.count_if(F.col("run_no") <= low), F.count("*")).first()
    if counted[0] != (done.rows if done else 0):
        raise LateRows(f"{counted[0] - (done.rows if done else 0)} rows arrived for runs up to {low}, which have been taken up")
    start = runs.agg(F.min("run_no")).first()[0]
    seen = sightings_with_status(listing, runs, headers, low, high).withColumn("bucket", bucket_of(buckets))
    state = None
    if done:
        # At most as many numbers as there are buckets. The sightings are written once and read for both.
        seen.write.parquet(f"{base}/seen")
        seen = store.spark.read.parquet(f"{base}/seen")
        state = store.state([r[0] for r in seen.where("processed").select("bucket").distinct().collect()])
    rows = changed_files(seen, state)
    rows.write.parquet(f"{base}/rows")
    rows = store.spark.read.parquet(f"{base}/rows")  # written once, read for output and state
    fresh = rows.where("ok AND changed AND NOT old").select("run_no", *FILE, (F.col("run_no") == start).alias("first"))
    fresh.write.parquet(f"{base}/output")
    last_versions(rows).withColumn("bucket", bucket_of(buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{base}/state")
    if before_publish:
        before_publish()
    written = {n.partition("=")[2]: f"{base}/state/{n}" for n in store._names(f"data/{number:06d}-{attempt}/state") if n.startswith("bucket=")}
    commit = Commit(number, low, int(high), f"{base}/output", (done.state if done else {}) | written, buckets, counted[1])
    store.publish(commit)
    store.vacuum(commit)
    return commit
