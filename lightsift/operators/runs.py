"""The registry of runs as a log of changes: list, default run, guarded deletion and its preview."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lightsift.functions import scalars as S
from lightsift.sources import commits
from lightsift.sources.snapshots import _fs

FIELDS = ["name", "folder", "status", "created_at", "n_images", "message"]
#: One row per change: seq orders them; op is create, update or delete; null fields of an update keep their value.
LOG = "run_id long, seq long, op string, name string, folder string, status string, created_at timestamp_ntz, n_images long, message string"


def current(log: DataFrame) -> DataFrame:
    """The runs that a log leaves: the last value of each field since the run was created; deleted runs are gone."""
    by = Window.partitionBy("run_id")
    since = log.withColumn("_born", F.max(F.when(F.col("op") == "create", F.col("seq"))).over(by)).where("seq >= _born")
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in FIELDS]
    return since.groupBy("run_id").agg(F.max(F.col("op") == "delete").alias("_gone"), *last).where("NOT _gone").drop("_gone")


def change(log: DataFrame, run_id: int, op: str, **fields: object) -> DataFrame:
    """The rows to append to the log for one change of one run."""
    unknown = set(fields) - set(FIELDS)
    if unknown or op not in ("create", "update", "delete"):
        raise ValueError(f"not a change of a run: {op} {sorted(unknown)}")
    start = {"status": "queued", "message": "Queued"} if op == "create" else {}
    values = start | fields
    seq = log.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("seq"))  # one row
    kinds = {f.name: f.dataType for f in log.schema.fields}
    return seq.select(F.lit(run_id).cast("long").alias("run_id"), "seq", F.lit(op).alias("op"), *[F.lit(values.get(f)).cast(kinds[f]).alias(f) for f in FIELDS])


def next_id(log: DataFrame) -> DataFrame:
    """One row, run_id: the number after all that were ever given."""
    return log.agg((F.coalesce(F.max("run_id"), F.lit(0)) + 1).alias("run_id"))


def listed(runs: DataFrame, ready_only: bool = False) -> DataFrame:
    """Runs, newest first."""
    return (runs.where("status = 'ready'") if ready_only else runs).orderBy(F.desc("run_id"))


def default_run(runs: DataFrame) -> DataFrame:
    """The newest ready run: one row, or none."""
    return runs.where("status = 'ready'").orderBy(F.desc("run_id")).limit(1)


def delete_preview(runs: DataFrame, files: DataFrame, busy: list[int] | None = None) -> DataFrame:
    """What deleting each run would destroy, from files (folder, path, size): originals are those under uploads/ of the run."""
    upload = F.col("path").contains("/uploads/")
    sums = files.groupBy("folder").agg(F.count_if(upload).alias("n_originals"), F.coalesce(F.sum(F.when(upload, F.col("size"))), F.lit(0)).alias("originals_bytes"), F.sum("size").alias("total_bytes"))
    out = runs.select("run_id", "name", "status", "n_images", "folder").join(sums, "folder", "left").drop("folder")
    numbers = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_originals", "originals_bytes", "total_bytes")}
    exists = F.col("total_bytes").isNotNull()
    return out.withColumn("exists", exists).withColumns(numbers).withColumns({"holds_originals": F.col("n_originals") > 0, "busy": F.col("run_id").isin(busy or [])})


def may_delete(runs: DataFrame, root: str, busy: list[int] | None = None) -> DataFrame:
    """runs with refusal: null if the run may be deleted, else why not: busy, outside (of the runs' root) or no_folder."""
    folder = F.regexp_replace(F.concat(F.lit(root.rstrip("/") + "/"), F.coalesce("folder", F.lit(""))), "/+$", "")
    home = F.lit(root.rstrip("/"))
    inside = folder.startswith(F.concat(home, F.lit("/"))) & ~F.col("folder").rlike(r"(^|/)\.\.(/|$)") & ~F.col("folder").startswith("/")
    return runs.withColumn("refusal", F.when(F.col("run_id").isin(busy or []), "busy").when((folder == home) | F.coalesce(F.trim("folder"), F.lit("")).isin("", "."), "no_folder").when(~inside, "outside"))


# --- a stored log ------------------------------------------------------------------------------
def stored_log(spark: SparkSession, root: str) -> DataFrame:
    """The log (see LOG) that `commit` appends to under root."""
    if not commits.numbers(spark, root):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).option("pathGlobFilter", "*.json").json(root)


def commit(spark: SparkSession, root: str, run_id: int | None, op: str, check: Callable[[DataFrame], None] = lambda runs: None, **fields: object) -> int:
    """Append one change of one run; of writers at the same time each gets its own place in the order. Returns the run's number.

    A run is created with the number after all that were ever given (run_id None). Changing a run that isn't there is an error.
    check gets the runs as they are just before the change and may raise; it is asked again whenever another writer came first.
    """
    if op == "create" and "folder" not in fields:
        fields["folder"] = None  # named after the number

    def make(n: int) -> dict:
        log = stored_log(spark, root)
        check(runs := current(log))
        own = next_id(log).first()["run_id"] if run_id is None else run_id
        if op != "create" and runs.where(F.col("run_id") == own).isEmpty():
            raise KeyError(f"no run {own}")
        row = change(log, own, op, **fields).withColumn("seq", F.lit(n).cast("long"))
        if op == "create" and fields["folder"] is None:
            row = row.withColumn("folder", S.folder_name(F.col("run_id"), F.coalesce("name", F.lit(""))))
        return {k: v if v is None or isinstance(v, (int, str)) else v.isoformat() for k, v in row.first().asDict().items()}

    return commits.append(spark, root, make)[1]["run_id"]


def reporter(spark: SparkSession, root: str, run_id: int) -> Callable[[int, str], None]:
    """A progress callback that records status and message of a run; 100 percent makes it ready."""

    def report(percent: int, message: str) -> None:
        commit(spark, root, run_id, "update", status="ready" if percent >= 100 else "running", message=message[:500])

    return report


class Refused(Exception):
    """A run that may not be deleted; says why."""


def delete_run(spark: SparkSession, root: str, runs_root: str, run_id: int, busy: list[int] | None = None) -> None:
    """Delete a run's folder and record that, if the guards of `may_delete` allow it and the folder holds something.

    The folder is first moved aside, by one rename; if the record can't be written it is moved back. So a refused or failed
    deletion leaves files and log as they were.
    """
    def allowed(runs: DataFrame) -> str:
        row = may_delete(runs, runs_root, busy).where(F.col("run_id") == run_id).first()
        if row is None:
            raise Refused("no such run")
        if row["refusal"]:
            raise Refused(row["refusal"])
        return f"{runs_root.rstrip('/')}/{row['folder']}"

    home = allowed(current(stored_log(spark, root)))
    fs, of = _fs(spark, home)
    if not fs.exists(of(home)) or not fs.listStatus(of(home)):
        raise Refused("no_files")
    aside = f"{runs_root.rstrip('/')}/.deleted-{uuid.uuid4().hex}"
    if not fs.rename(of(home), of(aside)):
        raise OSError(f"{home} can't be moved")
    try:
        commit(spark, root, run_id, "delete", check=allowed)
    except BaseException:
        fs.rename(of(aside), of(home))
        raise
    fs.delete(of(aside), True)
