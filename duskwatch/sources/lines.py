"""Plain text lines: reading, and filters by date, keyword and date range."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskwatch.session import materialize


#: Most rows of the table of file pieces that is broadcast; one is some hundred bytes. Beyond it Spark joins by shuffle.
MOST_PIECES = 500_000


def read_lines(spark: SparkSession, path, pattern: str | None = None) -> DataFrame:
    """``(value, log_file_path)`` of the text files at a path, folders searched in depth; no files give no rows."""
    return _placed(spark, path, pattern).select("value", "log_file_path")


def _placed(spark: SparkSession, path, pattern: str | None) -> DataFrame:
    """Lines with their file, the start of the piece of it that a task reads, and their place in the task."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    try:
        lines = reader.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
        return lines.select("value", F.col("file_path").alias("log_file_path"), F.col("file_block_start").alias("_piece"), F.monotonically_increasing_id().alias("_place"))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string, log_file_path string, _piece long, _place long")


def read_numbered(spark: SparkSession, path, pattern: str | None = None, header: bool = False) -> DataFrame:
    """``(value, log_file_path, line_id, line_no)``: lines with their number in the file, from 0, and an id from both.

    Ids depend on the files alone, not on how they are split, and lines are not shuffled for them. The files are read twice:
    first only to count the lines of each piece that a task reads, in a table of one row a piece, whose running sums give
    the number of a piece's first line; then each line adds its place in the piece. Both readings must split alike, which
    ``spark.sql.files.minPartitionNum`` sees to; if settings change in between, the job fails and gives no wrong number.

    With ``header`` each line also has its file's first line, as ``header``.
    """
    lines = _placed(spark, path, pattern)
    pieces = lines.groupBy("log_file_path", "_piece").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    in_file = Window.partitionBy("log_file_path").orderBy("_piece")
    pieces = pieces.withColumn("_before", F.sum("_lines").over(in_file) - F.col("_lines"))
    if header:
        top = lines.where("_piece = 0").groupBy("log_file_path").agg(F.min_by("value", "_place").alias("header"))
        pieces = pieces.join(top, "log_file_path")
    pieces = materialize(pieces, "pieces")
    if pieces.count() <= MOST_PIECES:
        pieces = F.broadcast(pieces)
    found = lines.join(pieces, ["log_file_path", "_piece"], "left")
    within = F.col("_place") - F.col("_first")
    alike = within.between(F.lit(0), F.col("_lines") - 1)
    split_anew = F.raise_error(F.lit("files were split otherwise when their lines were counted")).cast("long")
    number = F.when(F.coalesce(alike, F.lit(False)), F.col("_before") + within).otherwise(split_anew)
    found = found.select("value", "log_file_path", number.alias("line_no"), *["header"] * header)
    return found.withColumn("line_id", F.sha2(F.concat_ws("\n", "log_file_path", F.col("line_no").cast("string")), 256))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with further columns that are computed once each, however often later expressions use them.

    The optimizer copies a column's expression into every place that uses it, patterns included; it does not do so with what
    a generator gives, here one struct for each row.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def carried(lines: DataFrame) -> list[str]:
    """The columns besides the line itself that every parser hands on."""
    return [c for c in lines.columns if c in ("log_file_path", "line_id")]


def lines_by_date(lines: DataFrame, date: str, column: str = "value") -> DataFrame:
    """Lines that start with a date text."""
    return lines.filter(F.col(column).startswith(date))


def lines_by_keyword(lines: DataFrame, keyword: str, column: str = "value") -> DataFrame:
    """Lines that contain a keyword, whatever the case."""
    return lines.filter(F.lower(column).contains(keyword.lower()))


def lines_by_range(lines: DataFrame, start: str, end: str, column: str = "value") -> DataFrame:
    """Lines whose first token is a date from ``start`` to ``end``, both included; other lines are dropped."""
    first = F.regexp_extract(column, "^\\s*(\\S+)", 1)
    day = F.when(first.rlike("^\\d{4}-\\d{1,2}-\\d{1,2}$"), first.try_cast("date"))
    return lines.filter(day.between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def write_lines(lines: DataFrame, path: str, column: str = "value") -> None:
    lines.select(column).write.mode("overwrite").text(path)


def first_address(text: Column) -> Column:
    """The first IPv4 address in a text, or null."""
    return F.nullif(F.regexp_extract(text, "\\b((?:\\d{1,3}\\.){3}\\d{1,3})\\b", 1), F.lit(""))
