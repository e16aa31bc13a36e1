"""State between ticks as write-once versions, named by a commit log.

A version holds the tables of a tick and a manifest with the size and SHA-256 of every file, taken on
executors after the tables are written. Entry n of the log names a version; it is created only if there
is none yet, so of two writers that saw the same state one wins and the other is refused. State and
published copies are tables of one version and appear together with its entry. The newest entry counts.

What a commit that was cut off left behind has no entry: nobody reads it, prune() deletes it. A version
whose files differ from its manifest is passed over in favour of the newest sound one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of a version's table of files.
MANIFEST = "_manifest"


class Conflict(RuntimeError):
    """Another writer has committed since the state that this one is based on."""


class Damaged(RuntimeError):
    """No committed version has the files of its manifest."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file in one step, unless it is there: written aside, then renamed without overwriting."""
    tmp, fs = _fs(spark, f"{path}.{spark._jvm.java.util.UUID.randomUUID()}.tmp")
    out = fs.create(tmp, False)
    out.write(bytearray(text.encode()))
    out.close()
    to, _ = _fs(spark, path)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(tmp).toUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(tmp), fs.makeQualified(to), never)
    except Exception as e:
        if "FileAlreadyExistsException" not in str(e):
            raise
        fs.delete(tmp, False)
        return False
    return True


def _log(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, version) of the log's entries, newest first."""
    numbers = [n for n in _names(spark, f"{root}/log") if n.isdigit()]
    return [(int(n), spark.read.text(f"{root}/log/{n}", wholetext=True).first()[0].strip()) for n in reversed(numbers)]


def base(spark: SparkSession, root: str) -> int:
    """Number of the newest entry, 0 before the first: what commit() takes as the state that a tick is based on."""
    return max((int(n) for n in _names(spark, f"{root}/log") if n.isdigit()), default=0)


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the committed versions, newest first."""
    return [v for _, v in _log(spark, root)]


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, sha256) of all files of a version but its manifest; the bytes stay on executors."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    shown = found.filter(~F.contains("path", F.lit(f"/{MANIFEST}/")) & ~F.col("path").rlike(r"/[._][^/]*$"))
    return shown.select(name.alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def commit(tables: dict[str, DataFrame], root: str, stamp: str, keep: int = 14, on: int | None = None) -> str:
    """Write all tables of a tick as version `stamp`, its manifest, then its log entry, then prune.

    on: base() of the state that the tick read; if another entry has come since, Conflict is raised and nothing of
    this version can be seen. Without it the newest entry is taken as the base. A committed version is never written
    again; stamps must be new and sort by time.
    """
    spark = next(iter(tables.values())).sparkSession
    if stamp in versions(spark, root):
        raise FileExistsError(f"version {stamp} is there already")
    number = (base(spark, root) if on is None else on) + 1
    path = f"{root}/versions/{stamp}"
    if exists(spark, path):  # left by a commit that was cut off
        _delete(spark, path)
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    _files(spark, path).write.parquet(f"{path}/{MANIFEST}")
    if not _put_if_absent(spark, f"{root}/log/{number:012d}", stamp):
        _delete(spark, path)
        raise Conflict(f"entry {number} of {root} is another writer's")
    prune(spark, root, keep)
    return stamp


def damaged(spark: SparkSession, root: str, version: str) -> list[str]:
    """Files of a version that are missing, of another size or of another content than its manifest says; or added."""
    path = f"{root}/versions/{version}"
    if not exists(spark, f"{path}/{MANIFEST}/_SUCCESS"):
        return [MANIFEST]
    noted = spark.read.parquet(f"{path}/{MANIFEST}")
    both = noted.join(_files(spark, path).select("file", F.col("length").alias("_length"), F.col("sha256").alias("_sha256")), "file", "full")
    same = (F.col("length") == F.col("_length")) & (F.col("sha256") == F.col("_sha256"))
    return sorted(r["file"] for r in both.filter(~F.coalesce(same, F.lit(False))).select("file").collect())


def current(spark: SparkSession, root: str, check: bool = True) -> str | None:
    """The newest sound version; None where nothing was committed yet. Damaged where there are only damaged ones."""
    found = versions(spark, root)
    for version in found:
        if not check or not damaged(spark, root, version):
            return version
    if found:
        raise Damaged(f"{root} has no sound version")
    return None


def load(spark: SparkSession, root: str, name: str, schema: str, check: bool = True) -> DataFrame:
    """A table of the newest sound version; empty where there is none."""
    version = current(spark, root, check)
    path = f"{root}/versions/{version}/{name}"
    if version is None or not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def prune(spark: SparkSession, root: str, keep: int = 14) -> list[str]:
    """Delete all but the newest versions and the last one of each day (the first eight characters of its name).

    Leftovers without a log entry go too if they are older than the newest version. Returns what went.
    """
    log = _log(spark, root)
    if not log:
        return []
    stay, days = {v for _, v in log[:keep]}, set()
    for _, version in log:
        if (day := version[:8]).isdigit() and len(day) == 8 and day not in days:
            days.add(day)
            stay.add(version)
    gone = [v for _, v in log if v not in stay]
    left = [v for v in _names(spark, f"{root}/versions") if v < log[0][1] and v not in {v for _, v in log}]
    for number, version in log:
        if version in gone:
            _delete(spark, f"{root}/log/{number:012d}")
    for version in [*gone, *left]:
        _delete(spark, f"{root}/versions/{version}")
    return [*gone, *left]
