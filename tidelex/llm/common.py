"""What the operators of this folder share: tables, the shared work folder, and fixed expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of all text rules here: space, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none and runs on this machine alone."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidelex-"))
        at = sc.getCheckpointDir()
    return at


def new_dir(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder; whoever owns that folder empties it."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, kind: str) -> DataFrame:
    """The same rows as a table in the shared folder: its size is known when later joins are planned."""
    spark = df.sparkSession
    at = new_dir(spark, kind)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def free_name(df: DataFrame, name: str, *others: str) -> str:
    """A column name that df doesn't have and that isn't one of the others, by adding underscores."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(columns: list[tuple[str, str]]) -> Column:
    """A hash of a row's (column, type) values of any kind: those that Spark can't hash, maps and variants at any depth, go as JSON."""
    plain = lambda kind: "map<" not in kind and "variant" not in kind
    return F.xxhash64(*[F.col(c) if plain(kind) else F.to_json(F.struct(F.col(c))) for c, kind in columns])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y) of at most per_class labelled rows of each class that folds allow for learning, chosen by
    a hash of the id, and how many rows each class has in all. Labels come from rows whose crc32 fold of 4 is not 2.
    Repeated labels of an id count once, the larger one. Null ids and labels don't count."""
    y = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
        .groupBy("doc_id").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y"))
    )
    sizes = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    h = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    rows = [r for v in (0, 1) for r in y.where(F.col("y") == v).orderBy(h, "doc_id").limit(per_class).collect()]
    return docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in rows], "doc_id long, y int"), sizes
