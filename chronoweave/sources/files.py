"""Reading and writing the file formats of graphs, reports, prompts and logs, by Spark's readers and writers only."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from chronoweave.functions.rules import number_in
from chronoweave.session import stored

#: Formats by file ending; a compressed file's own ending is looked through by Spark.
FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc", "txt": "text"}


def read_csv(spark: SparkSession, path: str, schema: str | None = None, index: bool = False) -> DataFrame:
    """A CSV with a header, typed by ``schema`` or by inference (a second pass over the file); ``index``: drop the first column."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.drop(df.columns[0]) if index else df


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A dataset by its ending: csv, json, jsonl, parquet, orc or txt, gzipped or not, or arrow with a ``schema``."""
    kind = path.rstrip("/").removesuffix(".gz").rsplit(".", 1)[-1]
    if kind == "arrow" and schema:
        return read_arrow(spark, path, schema)
    if kind not in FORMATS:
        raise ValueError(f"no format known for {path}")
    if kind == "csv":
        return read_csv(spark, path, schema)
    reader = spark.read.format(FORMATS[kind])
    return (reader.schema(schema) if schema else reader).load(path)


def read_arrow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Arrow files or streams as a table of ``schema``, columns by name; a file (2 GB at most) is one task's work and passes through it batch by batch."""
    empty = spark.createDataFrame([], schema)
    kinds = to_arrow_schema(empty.schema)

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                buffer = content.as_buffer()
                reader = pa.ipc.open_file(buffer) if buffer[:6].to_pybytes() == b"ARROW1" else pa.ipc.open_stream(buffer)
                parts = (reader.get_batch(i) for i in range(reader.num_record_batches)) if hasattr(reader, "get_batch") else iter(reader)
                for part in parts:
                    yield pa.RecordBatch.from_arrays([part.column(f.name).cast(f.type) for f in kinds], schema=kinds)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(rows, empty.schema)


def read_prompts(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """JSON lines of several globs as one table of ``columns``; a column that the files lack is null."""
    df = spark.read.json(paths)
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def csv_to_jsonl(df: DataFrame, path: str, lists: list[str], order: list[str]) -> None:
    """Write ``df`` as JSON lines; ``lists`` columns are parsed from text where they hold a list, ``id`` numbers the rows by ``order``."""
    for c in lists:
        df = df.withColumn(c, F.coalesce(F.from_json(c, "array<string>"), F.array(c)))
    part = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    part = stored(part)
    before = part.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_o", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))
    numbered = part.join(F.broadcast(before), "_p").withColumn("id", F.col("_o") + F.row_number().over(Window.partitionBy("_p").orderBy("_i")) - 1)
    numbered.drop("_p", "_i", "_n", "_o").write.mode("overwrite").json(path)


def read_reports(spark: SparkSession, root: str, file_name: str) -> DataFrame:
    """Report CSVs under root/model/dataset/split/task/.../file_name, with those four as columns; shallower files are left out."""
    df = spark.read.option("header", True).option("inferSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", file_name).csv(root)
    scheme = r"^[a-zA-Z][a-zA-Z0-9+.-]*:/+"
    inner = F.split(F.substring_index(F.regexp_replace(F.input_file_name(), scheme, "/"), re.sub(scheme, "/", root).rstrip("/") + "/", -1), "/")
    df = df.withColumn("_p", inner).where(F.size("_p") >= 5)
    for i, c in enumerate(("model", "dataset", "split", "task")):
        df = df.withColumn(c, F.col("_p")[i])
    return df.drop("_p", "_c0", "Unnamed: 0", "experiment_name")


def concat_reports(reports: dict[str, DataFrame], dataset: str, split: str) -> DataFrame:
    """All reports under one another, ``model`` first, dataset and split overwritten; missing columns are null."""
    out = None
    for name, df in reports.items():
        one = df.drop("model").select(F.lit(name).alias("model"), "*").withColumns({"dataset": F.lit(dataset), "split": F.lit(split)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_baseline_edges(spark: SparkSession, path: str, initial: int, window: int, rescale: bool = True, cut_time: int | None = None, cut_edges: int | None = None) -> DataFrame:
    """(src, dst, t) of a generated edge CSV: rows that are no numbers go, t becomes t * window + initial, then a cut by time or count."""
    if (cut_time is None) == (cut_edges is None):
        raise ValueError("give either cut_time or cut_edges")
    e = spark.read.option("header", True).csv(path)
    e = e.select(*[F.col(c).try_cast("double").cast("long").alias(c) for c in ("src", "dst", "t")]).na.drop()
    e = e.withColumn("t", F.col("t") * window + initial) if rescale else e
    return e.where(F.col("t") <= cut_time) if cut_time is not None else e.orderBy("t", "src", "dst").limit(cut_edges)


def read_graphs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(model, src, dst, t) of several edge CSVs by name; rows that are no numbers go."""
    out = None
    for name, path in paths.items():
        e = spark.read.option("header", True).csv(path)
        e = e.select(F.lit(name).alias("model"), *[F.col(c).try_cast("double").cast("long").alias(c) for c in ("src", "dst", "t")]).na.drop()
        out = e if out is None else out.unionByName(e)
    return out


def read_metric_json(spark: SparkSession, path: str, section: str = "test metrics") -> DataFrame:
    """Metric files, one JSON object each, as wide rows of the section's values."""
    return spark.read.option("multiLine", True).json(path).select(F.col(f"`{section}`.*"))


def read_logs(spark: SparkSession, path: str, last: int = 18) -> DataFrame:
    """(file, key, value) of the ``test key, value`` entries among each log's last lines; a file is one group of lines.

    Log files are read whole, one row a file; a repeated key gets the suffix _degree the first time, _unique the second.
    """
    lines = F.split(F.rtrim("value"), "\n", -1)
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.slice(lines, F.greatest(F.size(lines) - last + 1, F.lit(1)), last)).alias("i", "line"))
    pattern = r"INFO - test ([^,]+), (.+)$"
    rows = rows.where(F.col("line").rlike(pattern)).select("file", "i", F.regexp_extract("line", pattern, 1).alias("key"), number_in(F.regexp_extract("line", pattern, 2)).alias("value"))
    w = Window.partitionBy("file", "key")
    nth = F.row_number().over(w.orderBy("i"))
    several = F.count("*").over(w) > 1
    return rows.select("file", F.concat("key", F.when(several & (nth == 1), "_degree").when(several, "_unique").otherwise("")).alias("key"), "value")


def write_split(df: DataFrame, path: str, column: str = "split") -> None:
    """Parquet partitioned by split, so that a reader of one split lists only its files."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def markdown_table(df: DataFrame, rows: int = 200) -> str:
    """A table of a report for reading; refuses more than ``rows`` rows."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"a table for reading has {rows} rows at most")
    line = lambda x: "| " + " | ".join("" if v is None else str(v) for v in x) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, got)])


def latex_table(df: DataFrame, rows: int = 200) -> str:
    """The same table for LaTeX."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"a table for reading has {rows} rows at most")
    line = lambda x: " & ".join("" if v is None else str(v).replace("_", r"\_").replace("&", r"\&") for v in x) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", line(df.columns), r"\hline", *map(line, got), r"\end{tabular}"])


def publish(df: DataFrame, root: str) -> int:
    """Write ``df`` as the next version under ``root`` and make it the one that ``current`` opens; its number.

    The data are written beside earlier versions first. A line in ``_versions`` then names them; it is one file that
    appears whole, so readers open either the version before or this one, and ``df`` may read an earlier version.
    """
    spark = df.sparkSession
    known = versions(spark, root)
    number = max(known, default=0) + 1
    path = f"{root}/v{number}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    spark.createDataFrame([(number, path)], "number long, path string").coalesce(1).write.mode("append").json(f"{root}/_versions")
    return number


def versions(spark: SparkSession, root: str) -> dict[int, str]:
    """Paths of the published versions by number; none where nothing has been published. Of two writers of one number the last path in order counts."""
    try:
        rows = spark.read.schema("number long, path string").json(f"{root}/_versions").orderBy("path").collect()  # one a publication
    except AnalysisException:  # no such folder yet
        return {}
    return {r.number: r.path for r in rows if r.number is not None}


def current(spark: SparkSession, root: str) -> DataFrame:
    """The table that was published last."""
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(known[max(known)])


def read_metric_tree(spark: SparkSession, root: str, section: str = "test metrics") -> DataFrame:
    """Metric files ``root``/model/dataset/*.json as rows: model and dataset from the path, then the section's values."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    part = F.split(F.input_file_name(), "/")
    name = lambda k: F.url_decode(F.regexp_replace(F.element_at(part, k), "^[a-z]+=", ""))
    return rows.select(name(-3).alias("model"), name(-2).alias("dataset"), F.col(f"`{section}`.*"))
