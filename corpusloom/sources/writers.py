"""Writers: tables with the documented order and header, small ones moved into place when they are whole."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import TOKEN_COLUMNS


def write_frequencies(counts: DataFrame, path: str, header: tuple[str, str] = ("lemma", "count")) -> None:
    """Sorted by falling count, equals by item; a range sort, so the files in order are the sorted table."""
    out = counts.orderBy(F.desc("count"), F.asc("item")).select(F.col("item").alias(header[0]), F.col("count").alias(header[1]))
    out.write.mode("errorifexists").option("header", "true").csv(path)


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Token records as TSV with all columns; columns that are missing are empty."""
    columns = [F.col(c) if c in tokens.columns else F.lit(None).cast("string").alias(c) for c in TOKEN_COLUMNS]
    tokens.select(*columns).write.mode("errorifexists").option("header", "true").option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def write_table(rows: DataFrame, path: str, sep: str = ",", digits: int = 6) -> None:
    """Any flat table; doubles with ``digits`` places."""
    shown = [F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    rows.select(*shown).write.mode("errorifexists").option("header", "true").option("sep", sep).csv(path)


def trace(tokens: DataFrame, only_keys: tuple[str, ...] = (), max_rows: int | None = None) -> DataFrame:
    """Included records for inspection, by position; a last row says if there were more than ``max_rows``."""
    rows = tokens.filter("included")
    if only_keys:
        rows = rows.filter(F.col("analysis_key").isin([k.lower() for k in only_keys]))
    rows = rows.select("global_token_index", "token", "lemma", "upos", "analysis_key").orderBy("global_token_index")
    if max_rows is None:
        return rows
    more = rows.limit(max_rows + 1).count() > max_rows
    shown = rows.limit(max_rows)
    if not more:
        return shown
    mark = rows.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("global_token_index"), F.lit("TRACE_TRUNCATED").alias("token"), *(F.lit(None).cast("string").alias(c) for c in ("lemma", "upos", "analysis_key")))
    return shown.unionByName(mark)


def write_json(path: str | Path, value: object) -> None:
    """Strict JSON, in place at once."""
    path = Path(path)
    handle, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, allow_nan=False, sort_keys=True, indent=1)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)


def cache_key(text: str, **behaviour: object) -> str:
    """Key of an annotation: hash of the text and of everything that shapes the result."""
    parts = {"text": hashlib.sha256(text.encode()).hexdigest(), **behaviour}
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def open_or_compute(spark, folder: str, key: str, compute) -> DataFrame:
    """Table kept under its key; Spark's commit marker says whether it is whole."""
    path = f"{folder}/{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def archive_manifest(files: list[str | Path]) -> dict[str, dict[str, object]]:
    """Size and hash of each file of a run."""
    return {str(p): {"bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest()} for p in map(Path, files) for raw in [p.read_bytes()]}
