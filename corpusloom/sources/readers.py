"""Readers. Text and tables are read by Spark; lists of rules and options are small and read on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stripped

TOKEN_COLUMNS = (
    "group source_file section chunk_index sentence_index token_index global_token_index char_start_in_chunk char_end_in_chunk "
    "char_start_in_text char_end_in_text sentence token lemma upos feats analysis_key included exclusion_reason ref_tag"
).split()
_NUMBERS = {c for c in TOKEN_COLUMNS if c.endswith("index") or c.startswith("char_")}
KEY_NAMES = ("lemma", "term", "key", "ngram", "token")
COUNT_NAMES = ("count", "freq", "frequency")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where a small table has fewer parts than there are cores; larger ones stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def text_files(spark: SparkSession, groups: Mapping[str, str | list[str]]) -> DataFrame:
    """``group, path, text``, a row per file of each group's globs; a file that isn't UTF-8 is an error."""
    out = None
    for group, paths in groups.items():
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        valid = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
        text = F.coalesce(valid, F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("string"))
        rows = rows.select(F.lit(group).alias("group"), "path", text.alias("text"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no groups")
    return out


def joined_text(files: DataFrame) -> DataFrame:
    """``group, text``: each group's files in order of path, a line break between."""
    rows = files.dropDuplicates(["group", "path"]).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("f"))
    return rows.select("group", F.array_join("f.text", "\n").alias("text"))


def frequency_csv(spark: SparkSession, path: str, label: str) -> DataFrame:
    """``label, item, count``; columns found by name, case aside; blank keys left out, repeated ones summed."""
    rows = spark.read.option("header", "true").csv(path)
    low = {c.strip().lower(): c for c in rows.columns}
    key = next((low[n] for n in KEY_NAMES if n in low), None)
    count = next((low[n] for n in COUNT_NAMES if n in low), None)
    if key is None or count is None:
        raise ValueError(f"no key or count column in {rows.columns}")
    number = F.expr(f"try_cast(trim(`{count}`) AS DOUBLE)")
    good = F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")) & (number >= 0), number)
    checked = F.coalesce(good, F.raise_error(F.concat(F.lit("not a count: "), F.coalesce(F.col(f"`{count}`"), F.lit("null")))).cast("double"))
    item = stripped(F.col(f"`{key}`"))
    return rows.select(F.lit(label).alias("label"), item.alias("item"), checked.alias("count")).filter("item <> ''").groupBy("label", "item").agg(F.sum("count").alias("count"))


def token_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Token records from TSV, with or without the column of morphology; an empty field is null."""
    rows = spark.read.option("header", "true").option("sep", "\t").option("quote", "").option("nullValue", "").csv(path)
    missing = set(TOKEN_COLUMNS) - {"feats"} - set(rows.columns)
    if missing or set(rows.columns) - set(TOKEN_COLUMNS):
        raise ValueError(f"not a token table: {rows.columns}")
    if "feats" not in rows.columns:
        rows = rows.withColumn("feats", F.lit(""))
    kind = lambda c: "bigint" if c in _NUMBERS else "boolean" if c == "included" else "string"
    return rows.select(*(F.col(c).cast(kind(c)).alias(c) if c != "feats" else F.coalesce("feats", F.lit("")).alias("feats") for c in TOKEN_COLUMNS))


def conllu(spark: SparkSession, path: str, min_length: int = 1) -> DataFrame:
    """``form, lemma``, lower-cased; only words all of letters, and long enough."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path).filter("value <> '' AND value NOT LIKE '#%'")
    cells = F.split("value", "\t")
    rows = rows.filter(F.size(cells) >= 3).select(F.lower(cells[1]).alias("form"), F.lower(cells[2]).alias("lemma"))
    good = lambda c: F.when((F.length(c) >= min_length) & F.col(c).rlike("^\\p{L}+$"), F.col(c))
    return rows.select(good("form").alias("form"), good("lemma").alias("lemma"))


def word_list(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """``item`` of each line that isn't blank or a comment."""
    item = stripped(F.col("value"))
    rows = spark.read.text(path).select((F.lower(item) if lower else item).alias("item"))
    return rows.filter("item <> '' AND item NOT LIKE '#%'").distinct()


def feature_table(spark: SparkSession, path: str, id_column: str, columns: Iterable[str] = (), prefixes: Iterable[str] = ()) -> DataFrame:
    """``id, feature, value`` of the chosen columns, in the header's order; ids must be unique, values finite."""
    rows = spark.read.option("header", "true").csv(path)
    chosen = [c for c in rows.columns if c != id_column and (c in set(columns) or any(c.startswith(p) for p in prefixes))]
    if id_column not in rows.columns or not chosen:
        raise ValueError("no id column or no feature columns")

    def number(c: str) -> Column:
        x = F.expr(f"try_cast(`{c}` AS DOUBLE)")
        return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)

    pairs = F.create_map(*[x for c in chosen for x in (F.lit(c), F.coalesce(number(c), F.raise_error(F.lit(f"not a finite number in {c}")).cast("double")))])
    if rows.groupBy(id_column).count().filter(f"`{id_column}` IS NULL OR count > 1").limit(1).count():
        raise ValueError("ids are missing or repeated")
    return rows.select(F.col(id_column).alias("id"), F.explode(pairs).alias("feature", "value"))


def metadata_csv(spark: SparkSession, path: str, id_column: str = "id", author: str = "author", work: str = "work") -> DataFrame:
    rows = spark.read.option("header", "true").csv(path)
    return rows.select(*(stripped(F.col(c)).alias(n) for c, n in ((id_column, "id"), (author, "author"), (work, "work"))))


# ------------------------------------------------------------------ small files, on the driver


def _lines(path: str | Path) -> list[str]:
    return [s for line in Path(path).read_text(encoding="utf-8").splitlines() if (s := line.strip()) and not s.startswith("#")]


def tag_patterns(path: str | Path) -> list[tuple[str, str]]:
    """Named patterns: ``name<TAB>pattern``, ``name: pattern`` or a bare pattern."""
    out = []
    for line in _lines(path):
        name, tab, pattern = line.partition("\t")
        if not tab:
            m = re.match(r"(\w+):\s+(.+)", line)
            name, pattern = (m[1], m[2]) if m else (f"pattern_{len(out) + 1}", line)
        re.compile(pattern)
        out.append((name.strip(), pattern.strip()))
    return out


def lemma_map(path: str | Path) -> dict[str, str]:
    """Two columns; of repeated keys the last counts."""
    out = {}
    for line in _lines(path):
        cells = line.split("\t")
        if len(cells) != 2:
            raise ValueError(f"not two columns: {line!r}")
        out[cells[0].strip()] = cells[1].strip()
    return out


def function_words(path: str | Path) -> list[str]:
    words = _lines(path)
    if len(set(words)) < len(words) or any(len(w.split()) > 1 for w in words):
        raise ValueError("function words must be single and occur once")
    return words


def roman_exceptions(path: str | Path) -> list[str]:
    return sorted({w.lower() for w in _lines(path)})


def lexicon(path: str | Path) -> dict[str, str]:
    return {c[0]: c[1] for line in _lines(path) if len(c := line.split("\t")) >= 2}
