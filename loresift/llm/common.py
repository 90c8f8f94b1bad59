"""Reading tables, cutting lineage and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: words are runs of anything else.
SPACE = "[\\x20\\x09-\\x0D]"
#: Rows that Python workers get at once; texts may be long.
ARROW_ROWS, ARROW_BYTES = "1024", 16 << 20


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="loresift-")
        sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir() or found


#: Folders of ``cut`` that were not discarded yet, and the session that wrote them.
_made: dict[str, SparkSession] = {}


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back from there; its lineage ends here."""
    spark = session(df)
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_to = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Deletes the folders of tables of ``cut`` that nothing reads any more."""
    for df in cuts:
        _delete(df.cut_to)


def _delete(path: str) -> None:
    spark = _made.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _discard_all() -> None:
    """At the driver's end what is left goes, as far as the session still lives."""
    for path in list(_made):
        try:
            _delete(path)
        except Exception:  # the session may be gone, and its folder with it
            return


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch, so that long texts don't fill a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > int(ARROW_ROWS):
        spark.conf.set(key, ARROW_ROWS)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, f"{ARROW_BYTES}b").rstrip("b")) > ARROW_BYTES:
        spark.conf.set(key, f"{ARROW_BYTES}b")


def need(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only ``columns``, so that extra columns, whatever their names, can't clash with what an operator adds."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def partitions_for(spark: SparkSession, rows: int, per: int, least: int = 1, most: int = 1 << 20) -> int:
    return int(min(most, max(least, -(-rows // per))))


def unit_of(*columns: str):
    """A uniform number in [0, 1) that depends on the columns only and that DuckDB computes alike."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
