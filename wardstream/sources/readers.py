"""Sources: flow, port, metadata and transfer CSV, archives, JSON lines, stage results."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardstream.functions.columns import finite
from wardstream.schema import FEATURES, FLOW_SCHEMA, META_NUMBERS, META_STRINGS

#: Places (from 0) of ts, src, dst, label, proto and the 32 statistics in the raw log.
RAW_PLACES = [7, 2, 3, 95, 6, *range(9, 41)]


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Headerless typed CSV of flows with an ``ingest_id`` in file order (stable for the same files)."""
    return spark.read.schema(FLOW_SCHEMA).csv(path).withColumn("ingest_id", F.monotonically_increasing_id())


def read_ports(spark: SparkSession, path: str) -> DataFrame:
    """CSV of ports with a header; NaN and null are 0."""
    df = spark.read.option("header", True).schema("sport double, dport double").csv(path)
    return df.withColumns({c: finite(c).cast("int") for c in ("sport", "dport")}).withColumn("ingest_id", F.monotonically_increasing_id())


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """CSV of forensic columns with a header; missing numbers are −1, missing texts empty."""
    head = spark.read.option("header", True).csv(path)
    typed = {c: F.coalesce(F.expr(f"try_cast(`{c}` as double)").cast("int"), F.lit(-1)) for c in META_NUMBERS if c in head.columns}
    return head.withColumns(typed | {c: F.coalesce(F.col(c), F.lit("")) for c in META_STRINGS if c in head.columns})


def project_raw(raw: DataFrame) -> DataFrame:
    """The 37 columns of the flow log from a raw wide table of text columns; blank, NaN and Inf are 0."""
    cols = raw.columns
    number = lambda i: finite(F.expr(f"try_cast(`{cols[i]}` as double)"))
    names = ["ts", "src", "dst", "label", *FEATURES]
    casts = {"ts": "long", "label": "byte"}
    return raw.select(*[(F.col(cols[i]) if n in ("src", "dst") else number(i).cast(casts.get(n, "float"))).alias(n) for n, i in zip(names, RAW_PLACES)])


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at ``path``, built once if it is missing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the text members of zip archives: ``archive, member, line_no, line``. Members are read as streams, line by line."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.namelist():
                        if m.endswith("/"):
                            continue
                        with z.open(m) as f:
                            rows = []
                            for i, line in enumerate(io.TextIOWrapper(f, "utf-8", errors="replace")):
                                rows.append((name, m, i, line.rstrip("\r\n")))
                                if len(rows) == 10_000:
                                    yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "line"])
                                    rows = []
                            yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "line"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(unzip, "archive string, member string, line_no long, line string")


_HEADER = re.compile(r"#*([^:]*)")


def clean_header(name: str) -> str:
    """A column name without leading # and what follows a colon."""
    return _HEADER.match(name).group(1)


def read_scenario(spark: SparkSession, path: str, labels: list[str], benign: str = "benign") -> DataFrame:
    """A transfer CSV: headers cleaned, rows with known labels only, ``ts`` in µs, ``label`` 0/1, numbers where they parse."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[clean_header(c) for c in df.columns]).where(F.col("label").isin(labels))
    text = {"c_ip", "s_ip", "label", "timestamp"}
    ts = F.coalesce(F.unix_micros(F.expr("try_cast(timestamp as timestamp)")), (F.expr("try_cast(timestamp as double)") * 1_000_000).cast("long"))
    out = df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in df.columns if c not in text})
    return out.withColumn("ts", ts).withColumn("label", (F.col("label") != benign).cast("byte")).drop("timestamp")


IDENTITY = ("ingest_id", "ts", "label", "c_ip", "s_ip", "c_port", "s_port", "src", "dst")


def load_scenario(spark: SparkSession, path: str, labels: list[str], benign: str = "benign") -> tuple[DataFrame, list[str]]:
    """A transfer data set ready for a detector: :func:`read_scenario` with ``src, dst, ingest_id``, the six causal host features, and the usable columns.

    ``ingest_id`` numbers rows by time, then by place in the files, as equal times must keep their order.
    Usable are columns more than nine tenths filled with more than one value that name no host, port, time
    or label; failed connections are those with a reset from either side.
    """
    from wardstream.operators.hostfeatures import host_features
    from wardstream.operators.ingest import positions, usable_columns

    raw = read_scenario(spark, path, labels).where("ts is not null").withColumn("__row", F.monotonically_increasing_id())
    df = positions(raw, ["ts", "__row"], "ingest_id").drop("__row").withColumns({"src": F.col("c_ip"), "dst": F.col("s_ip")})
    resets = [F.coalesce(F.col(c), F.lit(0.0)) > 0 for c in ("c_rst_cnt", "s_rst_cnt") if c in df.columns]
    failed = resets[0] | resets[1] if len(resets) == 2 else resets[0] if resets else F.lit(False)
    wide = host_features(df, failed)
    return wide, usable_columns(wide, [c for c in wide.columns if c not in IDENTITY])


NARRATIVE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("Subject", "Category", "Phase", "Automatic_verify_time")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("Segments", "Steps_submitted_time", "Content")]
)


def read_narratives(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of red-team records with lower-case names; lines that don't parse are left out."""
    df = spark.read.schema(T.StructType([*NARRATIVE.fields, T.StructField("_corrupt", T.StringType())])).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.select(*[F.col(f.name).alias(f.name.lower()) for f in NARRATIVE.fields]).where(F.coalesce(*[F.col(f.name.lower()).cast("string") for f in NARRATIVE.fields]).isNotNull())


def steps(narratives: DataFrame) -> DataFrame:
    """One row per submitted step: ``narrative_id, step_no, category, ts`` (µs; null if the time does not parse), ``segments``, ``ips``.

    ``ips`` are the well-formed IPv4 addresses anywhere in the record's content.
    """
    ips = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "content"), F.lit(r"(?<![0-9.])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9.])"), F.lit(1)))
    e = narratives.select("narrative_id", F.lower(F.trim("category")).alias("category"), F.posexplode("steps_submitted_time").alias("step_no", "__t"), F.coalesce("segments", F.array().cast("array<string>")).alias("segments"), ips.alias("ips"))
    return e.withColumn("ts", F.unix_micros(F.expr("try_cast(__t as timestamp)"))).drop("__t")


def compromised(narratives: DataFrame) -> DataFrame:
    """Distinct IPv4 addresses reported anywhere in the content: ``ip``."""
    from wardstream.operators.nested import addresses

    return addresses(narratives).select("ip").distinct()


def read_stage(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A stage's JSON result: one document, or with ``lines`` one object per line as :func:`wardstream.sources.sinks.write_json` writes."""
    return spark.read.option("multiLine", not lines).json(path)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``path, md5`` of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.md5("content").alias("md5"))
