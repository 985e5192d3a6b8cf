"""File readers and sinks, and the table of runs."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json_array(spark: SparkSession, path: str, schema: str = schemas.PAPERS) -> DataFrame:
    """A JSON file that holds one array."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str = schemas.DOCUMENTS) -> DataFrame:
    """A row per non-blank line; ``text`` is composed again, never trusted."""
    df = spark.read.schema(schema).json(path)
    if {"title", "abstract", "text"} <= set(df.columns):
        df = df.withColumn("text", T.compose(F.col("title"), F.col("abstract")))
    return df


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet, or no rows if there is none yet."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def write_records(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Records as Parquet or JSON lines."""
    getattr(df.write.mode("overwrite"), kind)(path)


def export_csv(papers: DataFrame, path: str) -> None:
    """Thirteen columns; authors, affiliations and sources joined by semicolons."""
    joined = lambda c: F.array_join(c, "; ")
    names = F.transform("authors", lambda a: F.coalesce(a["name"], F.lit("")))
    affiliations = F.array_distinct(F.flatten(F.transform("authors", lambda a: F.coalesce(a["affiliations"], F.array().cast("array<string>")))))
    plain = ("paper_id", "doi", "title", "abstract", "year", "venue", "url", "source", "time_window", "primary_topic")
    papers.select(*plain, joined(names).alias("authors"), joined(affiliations).alias("affiliations"), joined(F.col("sources")).alias("sources")).write.mode("overwrite").option(
        "header", True
    ).csv(path)


def seen_keys(papers: DataFrame) -> DataFrame:
    """(key_type, key) of a batch, for later scans to skip."""
    doi = papers.select(F.lit("doi").alias("key_type"), T.doi_key(F.col("doi")).alias("key"))
    title = papers.select(F.lit("title").alias("key_type"), T.title_key(F.col("title")).alias("key"))
    return doi.unionByName(title).where("key is not null and key <> ''").distinct()


RUNS = "run_id string, tag string, started timestamp, config string, artefacts map<string, string>"


def new_run(spark: SparkSession, root: str, tag: str, config: dict, commit: str | None = None) -> str:
    """A run id that sorts by time; its configuration, with the commit of the code if given, is appended to the table of runs."""
    config = config if commit is None else {**config, "commit": commit}
    run = f"{time.strftime('%Y%m%d_%H%M%S', time.gmtime())}_{tag}_{uuid.uuid4().hex[:6]}"
    row = spark.createDataFrame([(run, tag, json.dumps(config, sort_keys=True))], "run_id string, tag string, config string")
    row.select("run_id", "tag", F.current_timestamp().alias("started"), "config", F.create_map().cast("map<string,string>").alias("artefacts")).write.mode("append").parquet(f"{root}/runs")
    return run


def write_artefact(df: DataFrame, root: str, run: str, name: str) -> None:
    """A table of a run, and a row on it in the index of artefacts."""
    path = f"{root}/artefacts/run_id={run}/{name}"
    df.write.mode("overwrite").parquet(path)
    row = df.sparkSession.range(1).select(F.lit(run).alias("run_id"), F.lit(name).alias("name"), F.lit(path).alias("path"))
    row.write.mode("append").parquet(f"{root}/index")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """The table of runs with the artefacts of each: name to path."""
    index = read_or_empty(spark, f"{root}/index", "run_id string, name string, path string").distinct()
    held = index.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("name", "path")))).alias("held"))
    out = read_or_empty(spark, f"{root}/runs", RUNS).join(held, "run_id", "left")
    return out.withColumn("artefacts", F.coalesce("held", "artefacts")).drop("held")


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, term_id, tf) of a coordinate matrix in Matrix Market text, ids from 0: the long table that the operators take.

    The line of sizes is the first that is no comment; one file is one matrix.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.monotonically_increasing_id().alias("at")).where("value <> '' AND NOT startswith(value, '%')")
    sizes = lines.agg(F.min("at").alias("sizes"))
    parts = F.split("value", r"\s+")
    rows = lines.crossJoin(F.broadcast(sizes)).where("at > sizes")
    return rows.select((parts[0].cast("long") - 1).alias("doc_id"), (parts[1].cast("long") - 1).alias("term_id"), parts[2].cast("double").alias("tf"))


def latest_run(spark: SparkSession, root: str, tag: str) -> str | None:
    """The latest run of a tag, smoke runs left out."""
    row = read_or_empty(spark, f"{root}/runs", RUNS).where((F.col("tag") == tag) & ~F.contains("tag", F.lit("smoke"))).agg(F.max("run_id").alias("r")).first()
    return row["r"]


def blind_sheet(topics: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """A rating sheet without names, and its key: items in a seeded order from 1. A sheet has tens of rows."""
    from pyspark.sql import Window

    words = topics.groupBy("model", "topic_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term")))["term"].alias("words"))
    order = Window.orderBy(F.xxhash64(F.lit(seed), "model", "topic_id"), "model", "topic_id")
    keyed = words.withColumn("item", F.row_number().over(order))
    return keyed.select("item", "words"), keyed.select("item", "model", "topic_id")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file under a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_atomic(spark: SparkSession, path: str, text: str) -> None:
    """A small text file by writing beside it and renaming: readers see the old content or the new, never a part."""
    jvm = spark.sparkContext._jvm
    target, beside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.tmp"))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
    stream = context.create(beside, flags, options)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, target, rename)


def export_json_array(df: DataFrame, path: str, most: int = 100_000) -> None:
    """One JSON array in one file, for small exports; a table of more than ``most`` rows is an error (write_records has no bound)."""
    rows = df.select(F.to_json(F.struct(*df.columns))).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    write_atomic(df.sparkSession, path, "[" + ",\n".join(r[0] for r in rows) + "]\n")


def markdown_table(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A small table as Markdown; numbers at ``digits`` decimals, missing ones as a dash."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    shown = lambda v: "-" if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *([shown(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def latex_table(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A small table as the rows of a LaTeX tabular."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    escaped = lambda v: "".join(f"\\{c}" if c in "&%$#_{}" else c for c in v)
    shown = lambda v: "--" if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else escaped(str(v))
    body = [" & ".join(map(escaped, df.columns)), *(" & ".join(map(shown, r)) for r in rows)]
    return "\n".join(line + r" \\" for line in body) + "\n"
