"""What several operators of this package share: rows, words, learning split, scratch tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the word contract: space and the five ASCII controls 0x09-0x0D.
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"
#: A key is hot with more rows than this, and than this share of all rows.
HOT_ROWS, HOT_SHARE = 2000, 0.001
#: Rows of a few numbers up to this many are broadcast; beyond, joins shuffle.
MAX_BROADCAST = 2_000_000
#: Bounds of an Arrow batch, rows and bytes; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; a column that is missing is null, others are left out.

    Extra columns of a caller's table, whatever their names, never meet the names an
    operator uses inside.
    """
    have = {c.lower(): c for c in df.columns}
    cols = [
        (df[have[c]] if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()
    ]
    return df.select(*cols)


def words_of(text: Column) -> Column:
    """Words of a text as the contracts define them; no words for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_RE, -1)
    return F.array_remove(parts, "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(df: DataFrame, new: list[str], **types: str) -> DataFrame:
    """The caller's row as one struct ``row``, without the columns that ``new`` replaces, and the
    typed columns that an operator reads. Inside a struct no name can meet the operator's own."""
    new = {c.lower() for c in new}
    own = [F.col(quoted(c)) for c in df.columns if c.lower() not in new]
    row = F.struct(*own) if own else F.struct(F.lit(None).cast("string").alias("none"))
    have = {c.lower(): c for c in df.columns}
    read = [(F.col(quoted(have[c])) if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    return df.select(row.alias("row"), *read)


def small(df: DataFrame) -> DataFrame:
    """``df`` for broadcast if it has no more than MAX_BROADCAST rows, else as it is. For rows
    of a few numbers alone."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def attach(left: DataFrame, right: DataFrame, keys: list[str], count: str, kind: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``count`` how many rows of
    ``left`` the key has. Keys with more than HOT_ROWS rows and HOT_SHARE of all are no
    more than 1 / HOT_SHARE, so they are broadcast, and no task gets a hot key whole."""
    most = right.agg(F.sum(count).alias("all"), F.max(count).alias("top")).first()
    least = max(HOT_ROWS, HOT_SHARE * (most["all"] or 0))
    if (most["top"] or 0) <= least:
        return left.join(right, keys, kind)
    hot = F.broadcast(right.where(F.col(count) > least))
    cold = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(count) <= least), keys, kind)
    return left.join(hot, keys).unionByName(cold)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes for the session: Python
    workers hold whole texts and sets of a batch. A smaller bound that is set already stays."""
    for name, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        if not 0 < int(spark.conf.get(key).removesuffix("b")) <= most:
            spark.conf.set(key, str(most))


def tidy(kernel: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``kernel``, after which its worker gives free memory back to the system: an idle worker
    stays for a while, beside what the executor runs next."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from kernel(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir. A local session without the
    setting gets a temporary folder; on a cluster that folder would not be shared."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="vozmark-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


class Scratch:
    """Tables written to the shared folder to cut lineage, each under a name of its own.

    Written tables survive the loss of executors. ``drop`` removes those no longer read,
    ``last`` all but the one given back; what is left goes when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{scratch_dir(spark)}/vozmark-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.count = 0
        path, system = self._file(self.base)
        system.mkdirs(path)
        system.deleteOnExit(path)

    def _file(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        self.paths.append(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._vozmark_path = path
        return kept

    def append(self, table: DataFrame, df: DataFrame) -> DataFrame:
        """``table``, given by keep, with the rows of ``df`` added to its files."""
        df.write.mode("append").parquet(table._vozmark_path)
        grown = self.spark.read.schema(table.schema).parquet(table._vozmark_path)
        grown._vozmark_path = table._vozmark_path
        return grown

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df._vozmark_path)

    def last(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and drops every table written before."""
        before = list(self.paths)
        kept = self.keep(df)
        for path in before:
            self._delete(path)
        return kept

    def _delete(self, path: str) -> None:
        if path in self.paths:
            file, system = self._file(path)
            system.delete(file, True)
            self.paths.remove(path)
