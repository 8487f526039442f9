"""Small helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators' contracts define it, as a Java regex class body.
BLANK = r"\x20\x09-\x0D"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a folder of this machine is set; on a
    cluster executors would write to disks of their own, so a missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(remainder: int, modulus: int, doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's decimal text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids up to which a list of them is broadcast (8 bytes each); a longer list is joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` isn't in ``ids`` (a written table of that column); null ids stay, and all columns."""
    own = ids.select(F.col("doc_id").alias(free_name(docs)))
    small = own.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(own) if small else own, F.col("doc_id") == own[own.columns[0]], "left_anti")


def free_name(docs: DataFrame) -> str:
    """A column name that ``docs`` hasn't got, however names are compared."""
    taken = {c.lower() for c in docs.columns}
    return next(n for n in (f"own_{k}" for k in range(len(taken) + 1)) if n not in taken)
