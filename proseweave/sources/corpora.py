"""Reading and writing corpora: delimited files, parameter sweeps, malformed lines, stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quoted import read_quoted

# Field names of the files and the marker found in broken ones.
RUN_FIELDS = ["prompt", "generated_text", "model_name", "temperature", "num_beams", "index_paraphrase", "paraphrase_type", "altered_text"]
END_MARKER = "endoftextIllustration"
RUN_FOLDER = r"online_(.+)_paraphrase-(.+)_n(\d+)_p([0-9.]+)_q([0-9.]+)_alpha([0-9]+-[0-9]+)(_temperature_[0-9-]+)?/[^/]+$"

GENERATED = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("generated_text", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("num_beams", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)
ALTERED = T.StructType(
    GENERATED.fields[:5]
    + [
        T.StructField("index_paraphrase", T.StringType()),
        T.StructField("paraphase_type", T.StringType()),
        T.StructField("altered_text", T.StringType()),
    ]
)


def separator_of(spark: SparkSession, path: str) -> str:
    """Comma or tab, by which of them the header line holds more often."""
    header = spark.read.text(path).limit(1).collect()
    line = header[0]["value"] if header else ""
    return "\t" if line.count("\t") > line.count(",") else ","


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str | None = None, line_breaks: bool = True) -> DataFrame:
    """A delimited file with a header. Without a schema all columns are strings, nothing is inferred.
    ``line_breaks`` allows quoted line breaks inside fields: a pass over the quotes finds where records
    begin, so a file is still read by many tasks; turn it off for files written from flattened texts, which are read once."""
    sep = sep or separator_of(spark, path)
    if line_breaks:
        return read_quoted(spark, path, sep, schema)
    reader = spark.read.options(header=True, sep=sep, quote='"', escape='"')
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_sweep(spark: SparkSession, paths: list[str] | str, schema: T.StructType = ALTERED, line_breaks: bool = False) -> DataFrame:
    """All runs of a sweep in one scan, files split over tasks unless fields hold ``line_breaks``. The parameters are taken from the folder names; folders that do
    not exist simply do not match the glob."""
    rows = (
        spark.read.options(header=True, sep="\t", multiLine=line_breaks, quote='"', escape='"').schema(schema).csv(paths)
        .withColumn("_f", F.col("_metadata.file_path"))
    )
    part = lambda i: F.regexp_extract(F.url_decode("_f"), RUN_FOLDER, i)
    return rows.withColumns(
        {
            "llm_model": part(1),
            "paraphrase_model": part(2),
            "nb_paraphrase_max": part(3).try_cast("int"),
            "p_paraphrase": part(4).try_cast("double"),
            "q_paraphrase": part(5).try_cast("double"),
            "alpha_paraphrase": F.replace(part(6), F.lit("-"), F.lit(".")).try_cast("double"),
            "temperature_band": part(7),
        }
    ).drop("_f")


def offline_runs(df: DataFrame, model: str) -> DataFrame:
    """Unaltered runs with the columns of altered ones."""
    return df.withColumns(
        {
            "llm_model": F.lit(model),
            "paraphrase_model": F.lit(None).cast("string"),
            "altered_text": F.col("text"),
            "nb_paraphrase_max": F.lit(0),
            "paraphase_type": F.lit("absent"),
        }
    )


def join_five(df: DataFrame, parts: tuple[str, ...] = ("sentence1", "sentence2", "sentence3", "sentence4", "sentence5"), out: str = "text") -> DataFrame:
    """Sentence columns joined by a blank; null when one is missing."""
    pieces = []
    for p in parts:
        pieces += [F.lit(" "), F.col(p)]
    return df.withColumn(out, F.concat(*pieces[1:]))


def repair_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Keep lines of exactly eight tab fields, delete the end marker from the last, name the fields.
    A header line is recognised by its first field name."""
    f = F.split(column, "\t", -1)
    kept = lines.where(F.size(f) == len(RUN_FIELDS)).select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(RUN_FIELDS)])
    kept = kept.where(~((F.col("prompt") == "prompt") & (F.col("generated_text") == "generated_text")))
    return kept.withColumn("altered_text", F.replace("altered_text", F.lit(END_MARKER), F.lit("")))


def repair_file(spark: SparkSession, path: str) -> DataFrame:
    return repair_lines(spark.read.text(path))


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """CSV or TSV with a header. The default mode refuses to touch an existing run."""
    df.write.mode(mode).options(header=True, sep=sep, quote='"', escape='"').csv(path)


def write_once(df: DataFrame, path: str) -> None:
    """Store a run as Parquet unless it is already there."""
    df.write.mode("ignore").parquet(path)


def stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a stage table and go on from the stored copy, so a restart begins here."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def save_parameters(spark: SparkSession, params: dict, path: str) -> None:
    """Run parameters as a one-row JSON table next to the data."""
    row = {k: str(v) for k, v in params.items()}
    spark.createDataFrame([tuple(row.values())], list(row)).write.mode("ignore").json(path)
