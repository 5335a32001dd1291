"""Readers.

Every reader names its columns so Catalyst prunes the scan (``ReadSchema``)
and pushes filters into Parquet.  CSV is always read with an explicit schema:
schema inference is a full extra pass over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import norm_key, strip_ws


def table(spark: SparkSession, root: str, name: str, columns=None) -> DataFrame:
    """Parquet table ``{root}/{name}.parquet`` projected to ``columns``."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _csv(spark: SparkSession, schema, encoding: str, null_value: str | None, multi_line: bool):
    r = (spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
         .option("quote", '"').option("escape", '"').option("multiLine", multi_line))
    return (r if null_value is None else r.option("nullValue", null_value)).schema(schema)


def quotes_hold_breaks(spark: SparkSession, path, encoding: str = "UTF-8") -> bool:
    """Whether a line leaves a quote open, so that a field holds a line break:
    one count over the lines of files that can be split."""
    lines = spark.read.option("encoding", encoding).text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(F.max(quotes % 2).alias("odd")).first()["odd"] == 1


def read_csv(spark: SparkSession, path: str, schema, columns=None,
             encoding: str = "UTF-8", null_value: str | None = None, multi_line: bool | None = True) -> DataFrame:
    """CSV scan with header, explicit schema and a column list. Quoted fields may
    hold line breaks and doubled quotes; ``multi_line=False`` lets files without
    such breaks be split between tasks, ``None`` looks first whether there are any."""
    if multi_line is None:
        multi_line = quotes_hold_breaks(spark, path, encoding)
    df = _csv(spark, schema, encoding, null_value, multi_line).csv(path)
    return df.select(*columns) if columns else df


class MalformedRows(ValueError):
    """A CSV source has more malformed rows than allowed."""


def read_csv_counted(spark: SparkSession, path: str, schema, max_bad: int | None = None, encoding: str = "UTF-8",
                     null_value: str | None = None, multi_line: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, report) of a CSV source: S1 with an account of malformed rows.

    A row is malformed if it has too few or too many fields or a value that its
    type cannot hold. The report has one row per file with rows: ``file``,
    ``n_rows``, ``n_bad`` and ``example`` (the least malformed record, cut to 240
    characters). More than ``max_bad`` malformed rows in all raise
    ``MalformedRows``. Every column is parsed once and kept as a written table, so
    that what counts as malformed does not depend on the columns read later."""
    from ..session import cut_lineage
    if multi_line is None:
        multi_line = quotes_hold_breaks(spark, path, encoding)
    names = [f.name for f in schema.fields] if hasattr(schema, "fields") else [c.strip().split()[0].strip("`") for c in schema.split(",")]
    ddl = schema if hasattr(schema, "fields") else None
    full = ddl.add("_malformed", "string") if ddl is not None else f"{schema}, _malformed string"
    raw = (_csv(spark, full, encoding, null_value, multi_line).option("columnNameOfCorruptRecord", "_malformed")
           .option("columnPruning", False).csv(path))
    parsed = cut_lineage(raw.withColumn("_file", F.col("_metadata.file_path")))
    report = parsed.groupBy(F.col("_file").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("_malformed").alias("n_bad"), F.substring(F.min("_malformed"), 1, 240).alias("example"))
    if max_bad is not None:
        bad = parsed.select(F.count("_malformed").alias("n")).first()["n"]
        if bad > max_bad:
            raise MalformedRows(f"{bad} malformed rows in {path}, {max_bad} allowed")
    return parsed.where("_malformed IS NULL").select(*names), report


def read_csv_with_fallback(spark: SparkSession, path: str, schema, columns=None,
                           probe_cols=None, fallback: str = "ISO-8859-1"):
    """Read as UTF-8; if any decoded text holds the replacement character
    U+FFFD (the file was not UTF-8), read again as Latin-1.

    The probe is one distributed ``count_if`` over the string columns, not a
    driver-side decode. Returns (DataFrame, encoding used)."""
    df = read_csv(spark, path, schema, columns)
    cols = probe_cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not cols:
        return df, "UTF-8"
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.coalesce(F.col(c).contains("�"), F.lit(False))
    has_bad = df.select(F.count_if(bad).alias("n")).first()["n"] > 0
    if has_bad:
        return read_csv(spark, path, schema, columns, encoding=fallback), fallback
    return df, "UTF-8"


def resolve_column(df: DataFrame, candidates, target: str | None = None) -> DataFrame:
    """Pick the first column of ``candidates`` present in ``df`` (export
    versions name the value column differently) and rename it to ``target``."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        raise ValueError(f"none of the candidate columns {list(candidates)} found; have {df.columns}")
    name = present[0]
    return df.withColumnRenamed(name, target) if target and target != name else df


def load_mapping(mapping: DataFrame, source: str | None = None,
                 source_col: str = "source_name", canonical_col: str = "canonical_name",
                 dataset_col: str = "source_dataset", active_col: str = "active_flag") -> DataFrame:
    """Mapping dimension: required columns checked, text stripped, only
    active rows (of one source dataset when given), with a normalised key."""
    need = [source_col, canonical_col, dataset_col, active_col]
    missing = [c for c in need if c not in mapping.columns]
    if missing:
        raise ValueError(f"mapping table lacks columns {missing}")
    extra = [c for c in mapping.columns if c not in need]
    m = mapping.select(
        *extra,
        strip_ws(source_col).alias(source_col),
        strip_ws(canonical_col).alias(canonical_col),
        F.lower(strip_ws(dataset_col)).alias(dataset_col),
        F.col(active_col).try_cast("long").alias(active_col),
    ).filter(F.col(active_col) == 1)
    if source is not None:
        m = m.filter(F.col(dataset_col) == source.lower())
    return m.withColumn("map_key", norm_key(source_col))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of text files: (file, line_no, line), numbered from 1,
    line breaks as in ``str.splitlines``.

    Files are read in splits of any size. What a split adds to the numbers is the
    count of lines in the splits of the file before it, by their byte offsets. A
    file that lacks the break at its end is told by its size (in UTF-8; bytes that
    are no UTF-8 are read as U+FFFD and count as if the break were there)."""
    from ..operators.quality import LINE_BREAK
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("at"), F.col("value"))
    # as if every line ended in a break: the pair \r\n is one
    lines = raw.withColumn("parts", F.split(F.regexp_replace("value", r"\r\z", ""), LINE_BREAK))
    split = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # one split
    lines = lines.withColumn("before", F.coalesce(F.sum(F.size("parts")).over(split), F.lit(0)))
    each = raw.withColumn("n", F.size(F.split(F.regexp_replace("value", r"\r\z", ""), LINE_BREAK))).groupBy("file", "start").agg(
        F.sum("n").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"), F.max("at").alias("last"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # splits of one file
    whole = Window.partitionBy("file")
    offsets = each.select("file", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
                          F.when(F.max("start").over(whole) == F.col("start"), F.when(F.sum("bytes").over(whole) > F.col("size"), F.col("last"))).alias("open"))
    x = lines.join(offsets, ["file", "start"])
    unended = F.split(F.regexp_replace("value", rf"({LINE_BREAK})\z", ""), LINE_BREAK)
    parts = F.when(F.col("at") == F.col("open"), unended).otherwise(F.col("parts"))
    return x.select("file", (F.col("offset") + F.col("before")).alias("base"), F.posexplode(parts).alias("pos", "line")).select(
        "file", (F.col("base") + F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


def text_lines(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Explode a text column into numbered lines (1-based) over the whole
    text, line breaks as in ``str.splitlines``."""
    from ..operators.quality import split_lines
    return split_lines(df, text_col, id_col)


def file_hashes(spark: SparkSession, paths) -> DataFrame:
    """SHA-256 of file bytes, one row per file (``binaryFile`` source)."""
    return (spark.read.format("binaryFile").load(list(paths) if not isinstance(paths, str) else paths)
            .select(F.col("path"), F.col("length"), F.sha2(F.col("content"), 256).alias("sha256")))
