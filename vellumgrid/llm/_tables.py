"""How the operators keep intermediate tables and choose between a broadcast and a shuffle."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a table, counted beforehand, is sent to every executor.
BROADCAST_BYTES = 48 << 20
#: Bounds of an Arrow batch: Spark's default, and what is used instead while a table is kept.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def keep(df: DataFrame) -> DataFrame:
    """Compute a table once and cut its lineage, in the shared folder that spark.checkpoint.dir names.

    Lost executors cost nothing: the files are in the shared folder. Without such a folder the operators
    do not run, since a folder of one machine would not outlive it; only a session with a local master,
    which is one machine, gets a temporary one.

    While the table is computed, Python gets its rows in batches of BATCH, unless the session has bounds of its own;
    afterwards the session is as it was.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in BATCH}
    changed = {key: own for key, (given, own) in BATCH.items() if before[key] in (None, given)}
    try:
        for key, own in changed.items():
            conf.set(key, own)
        return df.checkpoint()
    finally:
        for key in changed:
            conf.unset(key) if before[key] is None else conf.set(key, before[key])


def text_key(text: Column) -> Column:
    """64 bits of a text's hash: with the id, the name of a row where ids repeat."""
    return F.xxhash64(text)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A kept table, sent to every executor in joins if its counted rows are within the bound; else the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def semi(big: DataFrame, small: DataFrame, keys: list[str], rows: int, row_bytes: int) -> DataFrame:
    """Left semi join that sends ``small`` to every executor only if its counted size is within the bound."""
    return big.join(F.broadcast(small) if rows * row_bytes <= BROADCAST_BYTES else small, keys, "left_semi")
