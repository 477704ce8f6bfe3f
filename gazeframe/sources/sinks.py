"""Writers: chosen columns to CSV, rows to JSON lines, bundles of tables. An existing target is never overwritten."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in that order; those that ``df`` lacks are empty, others are dropped."""
    df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns]).write.mode("errorifexists").option("header", True).csv(path)


def write_csv_file(df: DataFrame, path: str) -> None:
    """The rows as one plain CSV file with a header, for readers that go by file names; one task writes it. It appears whole or not at all."""
    spark = df.sparkSession
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, parts = files.Path(path), files.Path(f"{path}.parts")
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(target):
        raise FileExistsError(path)
    df.coalesce(1).write.mode("errorifexists").option("header", True).option("escape", '"').csv(f"{path}.parts")
    part = store.globStatus(files.Path(f"{path}.parts/part-*"))[0].getPath()
    store.rename(part, target)
    store.delete(parts, True)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_bundle(tables: dict[str, DataFrame], path: str, summary: str | None = None) -> None:
    """Each table as Parquet in a folder of its own, the table ``summary`` also as one JSON file, and last the manifest (name, rows).

    Nothing is written if the path is there already. The manifest comes last, so a bundle without one is not whole:
    ``read_manifest`` refuses it.
    """
    spark = next(iter(tables.values())).sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        raise FileExistsError(path)
    counts = []
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        counts.append((name, spark.read.schema(df.schema).parquet(f"{path}/{name}").count()))
    if summary is not None:
        write_json(spark.read.schema(tables[summary].schema).parquet(f"{path}/{summary}"), f"{path}/{summary}.json")
    write_json(spark.createDataFrame(counts, "name string, rows long"), f"{path}/manifest.json")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, rows) of a bundle's tables as found, checked against what its manifest says."""
    said = spark.read.schema("name string, rows long").json(f"{path}/manifest.json", multiLine=True)
    names = [r["name"] for r in said.orderBy("name").collect()]
    found = [spark.read.parquet(f"{path}/{n}").agg(F.count(F.lit(1)).alias("found")).select(F.lit(n).alias("name"), "found") for n in names]
    for part in found[1:]:
        found[0] = found[0].unionByName(part)
    wrong = F.raise_error(F.concat(F.lit("not the rows that the manifest names: "), "name"))
    return said.join(found[0], "name").select("name", F.when(F.col("rows") == F.col("found"), F.col("rows")).otherwise(wrong.cast("long")).alias("rows"))


def write_json(rows: DataFrame, path: str) -> None:
    """A small summary as one indented JSON array in one file; a summary of more than 10,000 rows is no small one."""
    found = rows.limit(10_001).collect()
    if len(found) > 10_000:
        raise ValueError("too many rows for a summary")
    text = json.dumps([r.asDict(recursive=True) for r in found], indent=2, default=str)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").option("lineSep", "\n").text(path)
