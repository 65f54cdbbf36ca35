"""Token sequences: n-grams, concordances, sampling windows."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, folded_key, stripped
from .annotate import BEFORE, BEHIND, LEXICAL, SENTENCE, any_case, listed, upos_of

SEQUENCE = ("group", "source_file", "section", "chunk_index", "sentence_index")


def assert_sequences(tokens: DataFrame) -> None:
    """Refuse repeated or negative positions; reads the tokens once."""
    bad = tokens.filter("token_index < 0 OR global_token_index < 0").limit(1).count()
    twice = tokens.groupBy("global_token_index").count().filter("count > 1").limit(1).count()
    if bad or twice:
        raise ValueError("token positions are negative or repeated")


def token_ngrams(tokens: DataFrame, n: int, *, column: str = "token", by_group: bool = False, min_count: int = 1,
                 top: int | None = None) -> DataFrame:
    """``[group,] ngram, count``: n neighbouring items of a sequence.

    Excluded tokens are passed over; an item without a letter or digit breaks the
    run. Grams of a sequence come from array slices: the sequence is shuffled once,
    not once per n.
    """
    if n < 1:
        raise ValueError("n must be positive")
    item = stripped(F.col(column))
    item = F.when(item.rlike("[\\p{L}\\p{N}]"), casefold(item))
    rows = tokens.filter("included").select(*SEQUENCE, "token_index", "global_token_index", item.alias("item"))
    seq = rows.groupBy(*SEQUENCE).agg(F.array_sort(F.collect_list(F.struct("token_index", "global_token_index", "item"))).alias("s"))
    starts = F.sequence(F.lit(1), F.size("s") - (n - 1))
    grams = F.when(F.size("s") >= n, F.transform(starts, lambda i: F.slice(F.col("s.item"), i, n)))
    runs = seq.select("group", F.explode(grams).alias("g")).filter(~F.exists("g", lambda x: x.isNull()))
    return _counted(runs.select("group", F.array_join("g", " ").alias("ngram")), by_group, min_count, top)


def _counted(grams: DataFrame, by_group: bool, min_count: int, top: int | None) -> DataFrame:
    keys = ["group"] if by_group else []
    out = grams.groupBy(*keys, "ngram").agg(F.count("*").alias("count")).filter(F.col("count") >= min_count)
    if top is None:
        return out
    order = [F.desc("count"), F.asc("ngram")]
    if not by_group:
        return out.orderBy(*order).limit(top)
    return out.withColumn("_r", F.row_number().over(Window.partitionBy("group").orderBy(*order))).filter(F.col("_r") <= top).drop("_r")


def token_stream(text: Column, skip: Collection[str] = ()) -> Column:
    """The tokens of ``annotate`` with a blank between neighbours and a line break where a run of n-grams ends.

    Runs end at the end of a sentence and at a token without a letter or digit. Tokens
    that are in ``skip``, in lower case, are passed over.
    """
    if skip:
        text = F.regexp_replace(text, f"{BEFORE}(?:{'|'.join(map(any_case, skip))}){BEHIND}", " ")
    text = F.regexp_replace(text, f"[^\\p{{L}}\\p{{M}}\\p{{N}} \\t\\x0B\\f\\r]++|{BEFORE}\\p{{M}}++(?![\\p{{L}}\\p{{N}}])", "\n")
    return F.regexp_replace(text, "[\\t\\x0B\\f\\r][ \\t\\x0B\\f\\r]*+| [ \\t\\x0B\\f\\r]++", " ")


def config_stream(text: Column) -> Column:
    """The tokens of ``config_tokens``, a blank between them; nothing ends a run."""
    return F.regexp_replace(text, "[^\\p{L}\\p{Nl}\\p{No}]++", " ")


def text_ngrams(docs: DataFrame, stream: Column, n: int, *, group: str = "lang", by_group: bool = False, min_count: int = 1,
                top: int | None = None) -> DataFrame:
    """What :func:`token_ngrams` makes of the tokens of ``docs``, from a stream of each text; only the counts are shuffled.

    Each row of ``docs`` is a document of its own.
    """
    if n < 1:
        raise ValueError("n must be positive")
    gram = f"(?<![^ \\n])(?=({' '.join(['[^ \\n]++'] * n)}))[^ \\n]++"
    rows = docs.select(F.col(group).alias("group"), F.explode(F.regexp_extract_all(stream, F.lit(gram), F.lit(1))).alias("g"))
    return _counted(rows.select("group", casefold(F.col("g")).alias("ngram")), by_group, min_count, top)


def concordance(tokens: DataFrame, keys: Collection[str], *, column: str = "lemma", window: int = 5) -> DataFrame:
    """Key words in context: ``window`` tokens of the same sequence on either side, excluded ones too.

    Only included tokens match. Tokens that bring their sentence along (``sentence_tokens``
    of ``annotate``) aren't shuffled. Of others, sequences without a match leave before
    the contexts are built.
    """
    wanted = sorted({k.strip().casefold() for k in keys})
    match = F.col("included") & casefold(stripped(F.col(column))).isin(wanted)
    if "sentence_tokens" in tokens.columns:
        at = F.col("token_index").cast("int")
        left = F.slice("sentence_tokens", F.greatest(at - window, F.lit(0)) + 1, F.least(at, F.lit(window)))
        return tokens.filter(match).select(
            "global_token_index", "group", "source_file", "sentence_index", F.array_join(left, " ").alias("left"), F.col("token").alias("match"),
            F.col(column).alias("key"), F.array_join(F.slice("sentence_tokens", at + 2, window), " ").alias("right"),
        )
    rows = tokens.withColumn("_m", F.coalesce(match, F.lit(False)))
    seq = rows.groupBy(*SEQUENCE).agg(
        F.array_sort(F.collect_list(F.struct("token_index", "global_token_index", "token", F.col(column).alias("key"), "_m"))).alias("s"),
        F.max("_m").alias("_any"),
    )
    hits = seq.filter("_any").select(*SEQUENCE, "s", F.posexplode("s").alias("i", "t")).filter("t._m")
    left = F.slice(F.col("s.token"), F.greatest(F.col("i") - window, F.lit(0)) + 1, F.least(F.col("i"), F.lit(window)))
    right = F.slice(F.col("s.token"), F.col("i") + 2, window)
    return hits.select(
        F.col("t.global_token_index").alias("global_token_index"), "group", "source_file", "sentence_index",
        F.array_join(left, " ").alias("left"), F.col("t.token").alias("match"), F.col("t.key").alias("key"),
        F.array_join(right, " ").alias("right"),
    )


def sample_windows(units: DataFrame, size: int, step: int | None = None, keep_partial: bool = True) -> DataFrame:
    """``..., sample_index, start_token, end_token, kind`` from ``units(..., n)``: half-open windows over n lexical tokens.

    Windows are full while they end within the unit; then there is at most one partial.
    """
    step = step or size
    if size < 1 or step < 1:
        raise ValueError("size and step must be positive")
    full = F.when(F.col("n") >= size, F.floor((F.col("n") - size) / step) + 1).otherwise(0)
    rest = (full * step < F.col("n")) & F.lit(keep_partial)
    number = full + rest.cast("bigint")
    out = units.withColumn("_full", full).select(*units.columns, "_full", F.explode(F.when(number > 0, F.sequence(F.lit(0).cast("bigint"), number - 1))).alias("sample_index"))
    return out.withColumns(
        {
            "start_token": F.col("sample_index") * step,
            "end_token": F.least(F.col("sample_index") * step + size, F.col("n")),
            "kind": F.when(F.col("sample_index") < F.col("_full"), "full").otherwise("partial"),
        }
    ).drop("_full")


def lexical_ordinals(lexical: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Eligible tokens with their ordinal in the unit, from 0."""
    order = Window.partitionBy(*unit).orderBy("global_token_index")
    return lexical.filter("eligible").withColumn("ordinal", (F.row_number().over(order) - 1).cast("bigint"))


def window_members(windows: DataFrame, ordinals: DataFrame, unit: Sequence[str], size: int, step: int | None = None) -> DataFrame:
    """Tokens of each window; overlapping windows are found by arithmetic, so the join is an equality."""
    step = step or size
    low = F.greatest(F.floor((F.col("ordinal") - size) / step) + 1, F.lit(0))
    spread = ordinals.withColumn("sample_index", F.explode(F.sequence(low.cast("bigint"), F.floor(F.col("ordinal") / step).cast("bigint"))))
    return spread.join(windows.select(*unit, "sample_index", "start_token", "end_token", "kind"), [*unit, "sample_index"]).filter(
        "ordinal >= start_token AND ordinal < end_token"
    )


def upos_ngrams(lexical: DataFrame, unit: Sequence[str], n: int) -> DataFrame:
    """``unit..., size, term, count, positions``: runs of n tags within a sentence, broken by a missing tag."""
    tag = folded_key(F.col("upos"))
    keys = [*unit, "source_file", "chunk_index", "sentence_index"]
    seq = lexical.filter("eligible").groupBy(*dict.fromkeys(keys)).agg(
        F.array_sort(F.collect_list(F.struct("global_token_index", F.upper(tag).alias("tag")))).alias("s")
    )
    grams = F.when(F.size("s") >= n, F.transform(F.sequence(F.lit(1), F.size("s") - (n - 1)), lambda i: F.slice(F.col("s.tag"), i, n)))
    rows = seq.select(*unit, F.explode(grams).alias("g")).filter(~F.exists("g", lambda x: x.isNull()))
    counts = rows.groupBy(*unit, F.array_join("g", "_").alias("term")).agg(F.count("*").alias("count"))
    positions = F.sum("count").over(Window.partitionBy(*unit))
    return counts.select(*unit, F.lit(n).cast("bigint").alias("size"), "term", "count", positions.alias("positions"))


def text_upos_ngrams(docs: DataFrame, unit: Sequence[str], n: int) -> DataFrame:
    """What :func:`upos_ngrams` makes of the lexical tokens of ``docs``, sentence by sentence; only the counts are shuffled."""
    rows = docs.select(*unit, F.explode(F.split("text", SENTENCE)).alias("s"))
    rows = rows.select(*unit, F.regexp_extract_all("s", F.lit(LEXICAL), F.lit(0)).alias("w"), F.col("s").rlike(f"^\\s*+{LEXICAL}").alias("led"))
    rows = rows.select(*unit, "w", "led", F.posexplode(listed("w")).alias("i", "t0")).filter(F.col("i") + n <= F.size("w"))
    rows = rows.select(*unit, "led", "i", "t0", *(F.get("w", F.col("i") + k).alias(f"t{k}") for k in range(1, n)))
    rows = rows.select("*", *(F.lower(f"t{k}").alias(f"_low{k}") for k in range(n)))  # used so often that they stay a projection of their own
    # only a sentence's first token is told apart, and only where it is a lexical one
    place = lambda k: F.lit(1) if k else F.when(F.col("led") & (F.col("i") == 0), 0).otherwise(1)
    tags = [upos_of(F.col(f"t{k}"), place(k), F.col(f"_low{k}")) for k in range(n)]
    counts = rows.select(*unit, F.concat_ws("_", *tags).alias("term")).groupBy(*unit, "term").agg(F.count("*").alias("count"))
    positions = F.sum("count").over(Window.partitionBy(*unit))
    return counts.select(*unit, F.lit(n).cast("bigint").alias("size"), "term", "count", positions.alias("positions"))


def window_types(docs: DataFrame, unit: Sequence[str], size: int, step: int | None = None) -> DataFrame:
    """``unit..., sample_index, tokens, types`` of the windows of lexical words over each unit's documents, in order of ``doc_id``.

    Words travel as texts: once to find a document's place in its unit, from the sizes of
    those before it, and once, cut to windows, to the windows that they are in.
    """
    step = step or size
    words = F.regexp_extract_all("text", F.lit(LEXICAL), F.lit(0))
    rows = docs.select(*unit, "doc_id", words.alias("_w")).select(*unit, "doc_id", F.size("_w").cast("bigint").alias("_n"), F.lower(F.array_join("_w", " ")).alias("_w"))
    before = Window.partitionBy(*unit).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_from", F.sum("_n").over(before) - F.col("_n")).withColumn("n", F.sum("_n").over(Window.partitionBy(*unit))).filter("_n > 0")
    full = F.when(F.col("n") >= size, F.floor((F.col("n") - size) / step) + 1).otherwise(0)
    last = full + (full * step < F.col("n")).cast("bigint") - 1  # as in sample_windows
    first = F.greatest(F.floor((F.col("_from") - size) / step) + 1, F.lit(0)).cast("bigint")
    last = F.least(F.floor((F.col("_from") + F.col("_n") - 1) / step), last).cast("bigint")
    rows = rows.select(*unit, "_from", "_n", F.split("_w", " ").alias("_w"), F.explode(F.when(first <= last, F.sequence(first, last))).alias("sample_index"))
    begin = F.greatest(F.col("sample_index") * step - F.col("_from"), F.lit(0))
    end = F.least(F.col("sample_index") * step + size - F.col("_from"), F.col("_n"))
    rows = rows.select(*unit, "sample_index", F.slice("_w", (begin + 1).cast("int"), (end - begin).cast("int")).alias("_w")).filter(F.size("_w") > 0)
    parts = rows.select(*unit, "sample_index", F.array_join("_w", " ").alias("_w")).repartition(*unit, "sample_index")
    whole = F.split(F.array_join(F.collect_list("_w"), " "), " ")
    found = parts.groupBy(*unit, "sample_index").agg(whole.alias("_w"))
    types = F.size(F.array_distinct("_w")).cast("bigint")
    return found.select(*unit, "sample_index", F.size("_w").cast("bigint").alias("tokens"), types.alias("types"))
