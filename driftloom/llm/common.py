"""Small helpers that the corpus operators share.

Row identity. Operators on documents identify a row by ``(dk, rh)``: the document id
(a null id sorts last) and a 64-bit hash of the raw text. Rows that agree on both are
repeated rows; each operator's docstring says what it returns for them.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import shipped

#: ASCII white space as the contracts define it: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
NULL_ID = 2**63 - 1
#: Bytes of texts in one batch for Python, where the session sets no bound of its own.
BATCH_BYTES = 16 << 20

_written: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's spark.checkpoint.dir.

    Only in local mode, where driver and executors are one process, a temporary folder
    stands in for an unset one; a cluster must name its folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    application = spark.sparkContext.applicationId
    if application not in _local:
        _local[application] = tempfile.mkdtemp(prefix="driftloom-")
    return _local[application]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it: lineage is cut durably.

    A lost executor costs a re-read, never a recomputation, so the file also fixes what
    would otherwise depend on how often it is computed. Files go when the session ends, or
    earlier by ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for ``forget``: how many tables have been written so far."""
    return len(_written)


def forget(since: int, until: int) -> None:
    """Delete the tables written between two marks; nothing may read them any more."""
    for spark, path in _written[since:until]:
        _delete(spark, path)
    del _written[since:until]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before
            return


def map_texts(df: DataFrame, f, schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in bytes: texts can be long, and a batch is in memory at once.

    Spark reads the bound from the session when the plan runs. Where the session has none
    it gets BATCH_BYTES, which only makes batches smaller.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) in (None, str(2**31 - 1)):
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return shipped(df).mapInArrow(f, schema)


def with_text_columns(docs: DataFrame, f: Callable[[list[str | None]], list[pa.Array]], made: dict[str, str]) -> DataFrame:
    """``docs`` with the columns ``made`` (name: type) that ``f`` makes of the texts of a batch; ones of these names are replaced."""
    taken = {n.lower() for n in made}
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])
    at, names = [c.lower() for c in kept.columns].index("text"), [*kept.columns, *made]
    schema = StructType(list(kept.schema.fields))
    for n, t in made.items():
        schema = schema.add(n, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *f(batch.column(at).to_pylist())], names=names)

    return map_texts(kept, run, schema)


def numbered(rows: DataFrame, keys: list[str], name: str = "occ") -> DataFrame:
    """``rows``, which have a unique long ``rid``, with their place 0, 1, ... among the rows that agree on ``keys``.

    ``rid`` holds the part of the table in its high bits, as monotonically_increasing_id
    makes it. Rows are numbered within their part and parts by their counts, so a hot key
    is spread over as many tasks as it has parts. Keys must not be null.
    """
    of_part = [*keys, "_part"]
    parted = rows.withColumn("_part", F.shiftright("rid", 33))
    within = F.row_number().over(W.partitionBy(*of_part).orderBy("rid")) - 1
    counts = parted.groupBy(*of_part).count()
    before = F.sum("count").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    before = counts.select(*of_part, before.alias("_before")).filter(F.col("_before") > 0)
    place = F.col("_within") + F.coalesce("_before", F.lit(0))
    return parted.withColumn("_within", within).join(before, of_part, "left").withColumn(name, place.cast("long")).drop("_within", "_before", "_part")


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` written in their total order, with ``rank`` 0, 1, ...: a distributed sort and the counts of its parts."""
    sorted_ = materialise(rows.orderBy(*order).withColumn("_rid", F.monotonically_increasing_id()))
    part = F.shiftright("_rid", 33)
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # a row for each part of the sort
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    at = F.col("_rid").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return sorted_.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("rank", at).drop("_part", "_rid", "_before")


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def text_or_empty() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def row_hash() -> Column:
    """Hash of the raw text, with null apart from empty."""
    return F.xxhash64(F.col("text").cast("string"), F.col("text").isNull())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def join_bounded(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", most_rows: int = 200_000, salts: int = 64) -> DataFrame:
    """Join ``small`` (one row per key) to ``big``, whose keys may be skewed.

    ``small`` is counted first; up to ``most_rows`` rows it is broadcast. A larger one is
    replicated ``salts`` times and joined by key and salt, so that a hot key of ``big`` is
    split over as many tasks.
    """
    if small.limit(most_rows + 1).count() <= most_rows:
        return big.join(F.broadcast(small), keys, how)
    salt = fresh(big, "_salt")[0]
    spread = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hashable = [F.col(c) for c in big.columns if big.schema[c].dataType.typeName() not in ("map", "variant")]
    salted = big.withColumn(salt, F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int"))
    return salted.join(spread, [*keys, salt], how).drop(salt)
