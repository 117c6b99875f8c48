"""Readers. Each returns a DataFrame; files are read by Spark's own sources, wherever they lie."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Encodings tried in order on the lines of a file.
ENCODINGS = ("UTF-8", "MS949", "EUC-KR")
_PYTHON = {"UTF-8": "utf-8", "MS949": "cp949", "EUC-KR": "euc-kr"}
# Fields of rental files and their names here, per building type.
RENT_FIELDS = {
    "시군구": "sigungu", "전용면적(㎡)": "area_m2", "계약면적(㎡)": "area_m2", "전월세구분": "contract_type", "계약년월": "contract_year_month", "보증금(만원)": "deposit_amount",
    "월세금(만원)": "monthly_rent", "월세(만원)": "monthly_rent", "층": "floor", "건축년도": "construction_year", "도로명": "road_name", "계약구분": "contract_status",
    "단지명": "building_name", "건물명": "building_name", "계약기간": "contract_period",
}


def allow(spark: SparkSession, encoding: str) -> str:
    """``encoding``, after Spark was told to accept it if it is none of its own."""
    if not encoding.upper().startswith(("UTF-", "ISO-8859-1", "US-ASCII")):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return encoding


def csv(spark: SparkSession, path: str, names: Mapping[str, str] | None = None, encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """A CSV with a header, all columns strings, some of them renamed."""
    df = spark.read.option("header", True).option("encoding", allow(spark, encoding)).option("sep", sep).option("inferSchema", False).csv(path)
    return df.withColumnsRenamed({k: v for k, v in (names or {}).items() if k in df.columns})


def _readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: for each of ENCODINGS whether all its lines can be read in it.

    No byte of a multi-byte sign is a line end in any of them, so a line can be judged
    alone, and a file by the lines of all its splits.
    """
    fine = dict.fromkeys(ENCODINGS, True)
    for batch in batches:
        lines = b"\n".join(batch["raw"].to_pylist())
        for name in ENCODINGS:
            try:
                if fine[name]:
                    lines.decode(_PYTHON[name], "strict")
            except UnicodeDecodeError:
                fine[name] = False
    yield pa.RecordBatch.from_pydict({name: [ok] for name, ok in fine.items()})


def probe_encoding(spark: SparkSession, path: str) -> str:
    """The first of ENCODINGS in which the files of a path can be read from end to end; UTF-8 if none fits.

    Each split is judged where it lies, and only verdicts reach the driver.
    """
    verdicts = spark.read.text(path).select(F.col("value").cast("binary").alias("raw")).mapInArrow(_readable, ", ".join(f"`{name}` boolean" for name in ENCODINGS))
    fits = verdicts.agg(*[F.bool_and(f"`{name}`").alias(name) for name in ENCODINGS]).first()
    return next((name for name in ENCODINGS if fits[name] is not False), "UTF-8")


def csv_any(spark: SparkSession, path: str, names: Mapping[str, str] | None = None) -> DataFrame:
    """A CSV in whichever encoding all of its lines can be read in."""
    return csv(spark, path, names, probe_encoding(spark, path))


def numbered_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Lines of text files: file, line_no (from 1 in each file) and value.

    Files are read in splits of bytes, as Spark cuts them. A split's lines are numbered as they
    are read, and what earlier splits of the file hold is added: one row a split is counted and summed, and no task has more than its splits.
    """
    read = spark.read.option("encoding", allow(spark, encoding)).text(path)
    lines = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("no"))
    splits = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("no").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = splits.select(F.col("file").alias("s_file"), F.col("start").alias("s_start"), "first", before.alias("before"))
    joined = lines.join(placed, (F.col("file") == F.col("s_file")) & (F.col("start") == F.col("s_start")))
    return joined.select("file", (F.col("before") + F.col("no") - F.col("first") + 1).cast("int").alias("line_no"), "value")


def csv_after_preamble(spark: SparkSession, path: str, schema: str, skip: int = 15, encoding: str = "UTF-8") -> DataFrame:
    """Rows of CSV files whose first ``skip`` lines are not part of the table, and whose next line is the header."""
    body = numbered_lines(spark, path, encoding).where((F.col("line_no") > skip + 1) & (F.trim("value") != ""))
    return body.select("file", "line_no", F.from_csv("value", schema).alias("row")).select("file", "line_no", "row.*")


def rent_rows(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A rental file with its Korean header renamed; columns it lacks are null."""
    df = csv(spark, path, RENT_FIELDS, encoding)
    wanted = dict.fromkeys(RENT_FIELDS.values())
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def dong_codes(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """line_no, name and code of the entries in force of a tab-separated code file; of equal names the last line wins."""
    parts = F.split("value", "\t")
    rows = numbered_lines(spark, path, encoding).where(F.size(parts) >= 3).select("line_no", F.trim(F.get(parts, F.lit(0))).alias("code"), F.trim(F.get(parts, F.lit(1))).alias("name"), F.trim(F.get(parts, F.lit(2))).alias("status"))
    return rows.where("status = '존재'").groupBy("name").agg(F.max("line_no").alias("line_no"), F.max_by("code", "line_no").alias("code"))


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Objects of files that each hold one JSON array."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, lines that are no JSON of this schema)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("row"))
    return parsed.where("row._corrupt IS NULL").select("row.*").drop("_corrupt"), parsed.where("row._corrupt IS NOT NULL").select(F.col("value").alias("raw_data"))


def or_empty(spark: SparkSession, path: str, schema: str, format: str = "json") -> DataFrame:
    """A table, or an empty one where the path is missing."""
    try:
        return spark.read.schema(schema).format(format).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def platform(spark: SparkSession, folder: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """The fixed tables of a platform's folder; a missing file is an empty table."""
    return {name: or_empty(spark, f"{folder}/{name}.json", schema) for name, schema in schemas.items()}


def latest(df: DataFrame, partition: str = "date") -> DataFrame:
    """The rows of the latest partition that has any; the scan of the others is pruned."""
    last = df.agg(F.max(partition).alias("last")).first()["last"]
    return df.where(F.lit(False)) if last is None else df.where(F.col(partition) == F.lit(last))


def latest_named(spark: SparkSession, pattern: str) -> DataFrame:
    """Of files with a date of eight digits in their name, the lines of the latest."""
    lines = spark.read.text(pattern).withColumn("file", F.col("_metadata.file_path"))
    day = F.regexp_extract("file", r"([0-9]{8})[^/]*$", 1)
    files = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("file")).withColumn("day", day).where("day != ''")
    last = F.broadcast(files.groupBy().agg(F.max("day").alias("last")))  # one row
    return lines.withColumn("day", day).join(last, F.col("day") == F.col("last")).drop("last")


def xml_rows(spark: SparkSession, path: str, tag: str = "row", schema: str | None = None) -> DataFrame:
    """The ``tag`` elements of XML files, a column for each child."""
    reader = spark.read.option("rowTag", tag)
    return (reader.schema(schema) if schema else reader).format("xml").load(path)


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """line_no, query and expected of ``query | keyword, keyword`` lines; comments and blank lines are skipped, keywords may be missing."""
    lines = numbered_lines(spark, path).withColumn("value", F.trim("value")).where("value != '' AND NOT startswith(value, '#')")
    parts = F.split("value", r"\|", 2)
    words = F.filter(F.transform(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), lambda w: F.trim(w)), lambda w: w != "")
    return lines.select("line_no", F.trim(F.get(parts, F.lit(0))).alias("query"), words.alias("expected"))


def with_sidecar(records: DataFrame, sidecar: DataFrame, key: str, column: str = "kv") -> DataFrame:
    """Records and their map of extra values; an empty map without one."""
    extra = sidecar.select(F.col(key).alias("_key"), F.col(column).alias("_kv"))
    return records.join(extra, F.col(key) == F.col("_key"), "left").withColumn(column, F.coalesce("_kv", F.create_map().cast("map<string,string>"))).drop("_key", "_kv")


def pdf_texts(spark: SparkSession, path: str) -> DataFrame:
    """file_name, full_text and error of PDF files, if a PDF library is installed; without one, or on a broken file, blank text and the error."""

    def read(batches):  # noqa: ANN001, ANN202
        import io

        import pandas as pd

        try:
            from pypdf import PdfReader
        except ModuleNotFoundError as e:
            missing: str | None = str(e)
        else:
            missing = None
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    if missing:
                        raise RuntimeError(missing)
                    rows.append((name, "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages), None))
                except Exception as e:  # noqa: BLE001 - any broken file is reported, not raised
                    rows.append((name, "", str(e)))
            yield pd.DataFrame(rows, columns=["file_name", "full_text", "error"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return found.select("path", "content").mapInPandas(read, "file_name string, full_text string, error string")


def with_order(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos``, from 1 in each file, in the order given; ``df`` has file."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy(*order)))
