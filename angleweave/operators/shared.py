"""Tables written to the folder that driver and executors share: a cut lineage that survives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session gets a folder of its own, a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="angleweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/angleweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Removes the tables that kept() wrote; to be called when no result is to be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/angleweave")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sizes_of(key):
    """How many rows each run of equal keys has; undefined keys are equal."""
    import numpy as np
    import pandas as pd

    codes = pd.factorize(key, use_na_sentinel=False)[0]
    return np.diff(np.concatenate([np.flatnonzero(np.diff(codes, prepend=-1)), [len(codes)]]))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """A stated number of partitions, as small tables would else be merged into one task of slow work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def chainwise(df: DataFrame, run: Callable, schema: str, key: str = "chain_id", order: str = "pos", whole: bool = False) -> DataFrame:
    """Runs run(frame) -> frame for the rows of every key, in their order, many keys a call of Python. What a task holds at once is a batch and one key's rows.
    whole=True gives run many keys' rows at once, key after key."""

    def batches(frames):
        import pandas as pd

        rest = None
        for b in frames:
            b = b if rest is None else pd.concat([rest, b])
            if not len(b):
                continue
            same = b[key].eq(b[key].iloc[-1]) | (b[key].isna() & pd.isna(b[key].iloc[-1]))
            ready, rest = b[~same], b[same]
            if len(ready):
                yield run(ready) if whole else pd.concat([run(x) for _, x in ready.groupby(key, sort=False, dropna=False)])
        if rest is not None and len(rest):
            yield run(rest)

    return spread(df, key).sortWithinPartitions(key, order).mapInPandas(batches, schema)
