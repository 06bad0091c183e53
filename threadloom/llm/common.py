"""Small pieces that several operators share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
WORD_RE = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and written to the session's reliable checkpoint folder.

    The folder is the one the cluster names in spark.checkpoint.dir. Only on a single machine, where that is unset, a
    temporary folder serves; on a cluster other machines wouldn't see it. Reliable checkpoints outlive executors, and
    Spark's own cleaner removes them.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="threadloom-"))
    return df.checkpoint()


def rest() -> None:
    """At a task's end: gives back what its batches took. Workers outlive tasks, and count against their executor."""
    pa.default_memory_pool().release_unused()


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; Spark's own lower() does that where every character is ASCII."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def strip_blanks(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; see cut()."""
    if (named := spark.conf.get("spark.checkpoint.dir", None)) is not None:
        return named.rstrip("/")
    cut(spark.range(0))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Keys that a salted join spreads over several tasks, at most.
HOT_KEYS = 1000


def salts(counts: DataFrame, keys: list[str], n: str, total: int) -> Column | None:
    """Into how many pieces a salted join splits a row's key; None: no key needs it. counts: keys, n (rows of the key).

    A key with more than a HOT_KEYS-th of the `total` rows is split into pieces of that size, up to a power of 2. As the
    counts add up to the total, never more than HOT_KEYS such keys come to the driver.
    """
    limit, own = max(1, -(-total // HOT_KEYS)), F.xxhash64(*keys)
    by_power: dict[int, list[int]] = {}
    for r in counts.where(F.col(n) > limit).select(own.alias("key"), F.ceil(F.col(n) / limit).cast("long").alias("pieces")).collect():
        by_power.setdefault(1 << (r["pieces"] - 1).bit_length(), []).append(r["key"])
    pieces = None
    for power, found in by_power.items():
        pieces = F.when(own.isin(found), power).otherwise(F.lit(1) if pieces is None else pieces)
    return pieces


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], pieces: Column | None, spread: list[str], how: str = "inner") -> DataFrame:
    """`big` joined to `small` by `keys`; a hash of `spread` deals the rows of a hot key to its pieces, where copies of
    the key's row in `small` wait. `pieces` comes from salts()."""
    if pieces is None:
        return big.join(small, keys, how)
    salt = F.pmod(F.xxhash64(F.lit(11), *spread), pieces.cast("long")).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return big.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def stored(df: DataFrame) -> DataFrame:
    """`df`, computed once, written as Parquet in the shared folder and read again.

    Unlike a checkpoint, whose plan keeps the sizes estimated for the plan before it, the result is as large as its files:
    over many joins in turn, estimates multiply to numbers that fill the driver, and small tables are never broadcast.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
