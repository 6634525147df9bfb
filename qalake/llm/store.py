"""Written intermediate tables and bounded Bloom filters."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalake.session import ensure_checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder of ``spark.checkpoint.dir``:
    lineage is cut there and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Deletes the files of a ``written`` table that nothing will read again."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def bloom_filter(keys: DataFrame, col: str, log_words: int = 19) -> np.ndarray:
    """Blocked Bloom filter of column ``col`` (long, already well mixed):
    three bits of one 64-bit word per key.

    Its size is fixed by ``log_words`` (2**19 words are 4 MB), whatever the
    number of keys; more keys mean more false positives, never a miss. One
    row per word reaches the driver, 2**log_words at most."""
    k = f"`{col}`"
    got = (keys.select(F.expr(f"cast(shiftrightunsigned({k}, 40) & {(1 << log_words) - 1} as int)").alias("w"),
                       F.expr(f"shiftleft(1L, cast({k} & 63 as int)) | shiftleft(1L, cast(shiftright({k}, 6) & 63 as int))"
                              f" | shiftleft(1L, cast(shiftright({k}, 12) & 63 as int))").alias("m"))
           .where(F.col("w").isNotNull()).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow())
    words = np.zeros(1 << log_words, np.uint64)
    words[got.column("w").to_numpy()] = got.column("m").to_numpy().view(np.uint64)
    return words


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For uint64 keys: False only where the key is certainly absent."""
    one, low = np.uint64(1), np.uint64(63)
    m = (one << (keys & low)) | (one << ((keys >> np.uint64(6)) & low)) | (one << ((keys >> np.uint64(12)) & low))
    return (words[((keys >> np.uint64(40)) & np.uint64(len(words) - 1)).astype(np.int64)] & m) == m
