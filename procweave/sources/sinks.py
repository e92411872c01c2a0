"""Writing results: files by name, JSON reports, the graph, and run tables.

All of it goes through Spark's writers and Hadoop's file systems, so any store that Spark knows will do.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.session import spread


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one in local mode if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write a table that several plans read to the shared folder, and read it back: it is made once, and lineage ends there."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_files(texts: DataFrame, folder: str, kind: str, text: str) -> None:
    """One text file for each row, in a folder named after its kind. All cores write, since files take their time one by one, however small."""
    spread(texts).select(F.lit(kind).alias("kind"), F.col(text).alias("value")).write.partitionBy("kind").option("maxRecordsPerFile", 1).mode("append").text(folder)


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def hadoop(spark: SparkSession, path: str):
    """A path of Hadoop's, and its file system."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Files that are renamed at the same time; each is one call to the store.
RENAMES = 16


def write_named(texts: DataFrame, folder: str, name: str, text: str) -> int:
    """Each row's text in a file of its own name; of rows with the same name the last text in order. How many files there are.

    Tasks write to a staging folder, under Spark's own commit. Only when all of them are done are the files renamed into
    place, so a job that fails leaves no file behind. A file that is there already is replaced. Rows without a name are left out.
    """
    spark = texts.sparkSession
    staged = f"{folder.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    rows = texts.filter(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(F.col(name).alias("file_name")).agg(F.max(F.coalesce(F.col(text), F.lit(""))).alias("value"))
    root, files = hadoop(spark, staged)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    try:
        # All cores write: the rows are small, their files are not.
        rows.repartition(spark.sparkContext.defaultParallelism, "file_name").write.partitionBy("file_name").text(staged)
        found = files.globStatus(path(f"{staged}/file_name=*/part-*"))
        there = {f.getPath().getName() for f in files.listStatus(root.getParent())}

        def place(part) -> None:
            own = part.getPath()
            file_name = unquote(own.getParent().getName().removeprefix("file_name="))
            target = path(root.getParent(), file_name)
            if file_name in there:
                files.delete(target, False)
            if not files.rename(own, target):
                raise OSError(f"cannot rename to {target.toString()}")

        with ThreadPoolExecutor(RENAMES) as pool:
            return sum(1 for _ in pool.map(place, found))
    finally:
        files.delete(root, True)


#: Buckets of a graph that is upserted by key; a graph keeps the number that it was made with.
BUCKETS = 64


def manifest_of(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The latest version of a graph's manifest (-1 if there is none): its number, buckets and the folder of each."""
    root, files = hadoop(spark, f"{path}/_manifest")
    if not files.exists(root):
        return -1, {"buckets": BUCKETS, "folders": {}}
    numbers = [int(f.getPath().getName().removesuffix(".json")) for f in files.listStatus(root) if f.getPath().getName().endswith(".json")]
    if not numbers:
        return -1, {"buckets": BUCKETS, "folders": {}}
    return max(numbers), json.loads(spark.read.text(f"{path}/_manifest/{max(numbers)}.json", wholetext=True).first()[0])


def read_upserted(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a graph as its latest manifest has them."""
    _, manifest = manifest_of(spark, path)
    folders = sorted(set(manifest["folders"].values()))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Merge rows by their keys into the table at path: new keys are added, properties that are not null replace those of old rows.

    Rows are dealt to buckets by their keys; only buckets that rows fall to are read and written anew, in new folders, and a
    new manifest, made last, points to them. Until then readers see the version before, also after a failure. Two writers
    at once make the same manifest: the later one fails. Of rows with one key, the largest properties count. Returns the version.
    """
    spark, properties = rows.sparkSession, [c for c in rows.columns if c not in keys]
    number, manifest = manifest_of(spark, path)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(manifest["buckets"])).cast("int")
    new = kept(rows.groupBy(*keys).agg(F.count("*").alias("_rows"), *[F.max(p).alias(p) for p in properties]).drop("_rows").withColumn("_bucket", bucket), "upsert")
    touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())
    before = [manifest["folders"][str(b)] for b in touched if str(b) in manifest["folders"]]
    merged = new.withColumn("_new", F.lit(1))
    if before:
        old = spark.read.schema(rows.schema).parquet(*before).withColumn("_bucket", bucket).withColumn("_new", F.lit(0))
        merged = merged.unionByName(old)
    latest = [F.max_by(p, F.when(F.col(p).isNotNull(), F.col("_new"))).alias(p) for p in properties]
    merged = merged.groupBy("_bucket", *keys).agg(F.max("_new").alias("_new"), *latest).drop("_new")
    version = f"{path}/data/{uuid.uuid4().hex}"
    # One file a bucket: all its rows are in one task.
    merged.repartition(max(1, min(len(touched), manifest["buckets"])), "_bucket").write.partitionBy("_bucket").parquet(version)
    folders = manifest["folders"] | {str(b): f"{version}/_bucket={b}" for b in touched}
    target, files = hadoop(spark, f"{path}/_manifest/{number + 1}.json")
    out = files.create(target, False)
    out.write(json.dumps({"buckets": manifest["buckets"], "folders": folders}).encode())
    out.close()
    return number + 1


def write_graph(edges: DataFrame, path: str, label: str) -> None:
    """Replace the edges of one label; those of other labels stay."""
    edges.dropDuplicates().write.mode("overwrite").parquet(f"{path}/label={label}")


def clear_graph(spark: SparkSession, path: str, label: str) -> None:
    """Remove the edges of one label only."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/label={label}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def append_runs(rows: DataFrame, path: str) -> None:
    """Append states of runs; the latest state is the one in force."""
    rows.write.mode("append").parquet(path)
