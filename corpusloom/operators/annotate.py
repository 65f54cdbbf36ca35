"""From documents to one row per token.

``annotate`` is the rule annotator, all in SQL; ``annotate_with`` takes any callable
from text to sentences of tokens and runs it in Arrow batches, chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ROMAN, SURFACE_EXCEPTIONS

SENTENCE = "[.!?\\n]+"
TOKEN = "[\\p{L}\\p{M}\\p{N}]+|[^\\s\\p{L}\\p{M}\\p{N}]"
#: Tokens straight from a text that a line break is put before; the first of a sentence bring along what ends the one before.
MARKED = "(?:[.!?\\n][\\s.!?\\n]*+)?+(?:[\\p{L}\\p{M}\\p{N}]++|[^\\s\\p{L}\\p{M}\\p{N}.!?\\n])"
#: Before and behind a word; a letter beyond 16 bits in the pattern makes Java look back by letters, not by halves of them.
BEFORE = "(?<![\\p{L}\\p{M}\\p{N}\U00010400])"
BEHIND = "(?![\\p{L}\\p{M}\\p{N}])"


def any_case(pattern: str) -> str:
    """A pattern of small letters, for what is these in lower case; the flag for that takes other letters too."""
    signs = {"k": "\u212a", "å": "\u212b", "ω": "\u2126"}
    return "".join(f"[{c}{c.upper()}{signs.get(c, '')}]" if c.isalpha() else c for c in pattern)


#: The tokens that ``lexical`` takes: words with a letter or digit that aren't Roman numerals. Most show by their first letter that they are none.
LEXICAL = (
    f"{BEFORE}(?:[abe-hjkn-uwyzABE-HJKN-UWYZ]|(?!(?!(?:{'|'.join(map(any_case, SURFACE_EXCEPTIONS))}){BEHIND}){any_case(ROMAN.strip('^$'))}{BEHIND})"
    "(?=\\p{M}*+[\\p{L}\\p{N}]))[\\p{L}\\p{M}\\p{N}]*+"
)
#: Characters of a chunk that an annotator gets at once.
CHUNK = 200_000

CLOSED = {
    "ADP": "of in to with for on by from at de à en por con par pour dans mit von zu auf für im".split(),
    "CCONJ": "and or but et ou mais und oder aber y o pero".split(),
    "DET": "the a an this that le la les un une des der die das ein eine el los las".split(),
    "PRON": "he it i you we they il elle je ich er sie yo que qui".split(),
    "AUX": "is are be was were est sont ist sind es son".split(),
}
ENDINGS = {"VERB": ("ing", "ed", "er", "en", "ar", "ir"), "ADJ": ("ble", "ous", "ive", "lich", "eux"), "ADV": ("ly", "ment")}
SUFFIXES = {tag: f"({'|'.join(ends)})$" for tag, ends in ENDINGS.items()}


def upos_of(token: Column, index: Column, low: Column | None = None) -> Column:
    """Tag of a token; ``low`` is the token in lower case where it is at hand, so that it isn't made for each test."""
    low = F.lower(token) if low is None else low
    out = F.when(~token.rlike("[\\p{L}\\p{N}]"), "PUNCT").when(token.rlike("^\\p{N}+$"), "NUM")
    for tag, words in CLOSED.items():
        out = out.when(low.isin(words), tag)
    out = out.when((index > 0) & token.rlike("^\\p{Lu}"), "PROPN")
    for tag, ends in ENDINGS.items():  # plain comparisons: a pattern for each token and tag would cost far more
        out = out.when(reduce(or_, (low.endswith(e) for e in ends)), tag)
    return out.otherwise("NOUN")


def lemma_of(token: Column, low: Column | None = None) -> Column:
    """Lower case; a longer word loses its final s."""
    low = F.lower(token) if low is None else low
    return F.when((F.length(low) > 4) & low.endswith("s"), F.left(low, F.length(low) - 1)).otherwise(low)


def feats_of(token: Column, upos: Column, low: Column | None = None) -> Column:
    low = F.lower(token) if low is None else low
    number = F.when(low.endswith("s"), "Number=Plur").otherwise("Number=Sing")
    case = F.when(F.right(low, F.lit(1)).isin(*"aeiou"), "Case=Nom").otherwise("Case=Acc")
    return F.when(upos.isin("NOUN", "PROPN"), F.concat_ws("|", case, number)).when(upos == "VERB", "VerbForm=Fin").otherwise("")


def token_number(place: Column) -> Column:
    """A token's number in the corpus, from its ``doc_id`` and its place in the document."""
    doc = F.col("doc_id").cast("bigint")
    wrong = F.raise_error(F.concat(F.lit("doc_id must be a number of at most 31 bits: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return F.when(doc.between(0, 2**31 - 1), F.shiftleft(doc, 32) + place).otherwise(wrong.cast("bigint"))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sums_before(sizes: pa.Array) -> pa.Array:
    """For each size of a list the sum of those before it."""
    flat, ends = sizes.flatten().to_numpy(zero_copy_only=False), sizes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    before, starts = np.concatenate([[0], flat.cumsum()]), np.concatenate([[0], ends])
    rows = before[:-1] - np.repeat(before[starts[:-1]], np.diff(starts))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(rows, pa.int64()))


def listed(name: str) -> Column:
    """An array to explode. For a bare column Spark adds a filter on its size, moves that down and so makes the array twice."""
    return F.when(F.size(name) > 0, F.col(name))


def annotate(docs: DataFrame, group: str = "lang", with_sentence: bool = False, with_tokens: bool = False) -> DataFrame:
    """Token records of ``docs(doc_id, text, ...)``; two generators, no shuffle.

    ``global_token_index`` is unique and rises with document and position: the
    document's id in the upper half, the place in the document in the lower. An id
    outside 0 to 2**31 - 1 is an error. Other columns of ``docs`` but the text are
    carried along. ``with_tokens`` adds ``sentence_tokens``, all tokens of the record's
    sentence, so that its neighbours are at hand without a shuffle.
    """
    kept = [c for c in docs.columns if c not in ("text", "n_chars", group)]
    split = F.transform(F.split("text", SENTENCE), lambda s: F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0)))
    rows = docs.select(F.col(group).alias("group"), *kept, *([F.split("text", SENTENCE).alias("_texts")] if with_sentence else []), split.alias("_tokens"))
    rows = rows.withColumn("_starts", _sums_before(F.transform("_tokens", lambda t: F.size(t).cast("bigint"))))  # of no use, it isn't made
    text = ["_texts"] if with_sentence else []
    rows = rows.select("group", *kept, *text, "_starts", F.posexplode(listed("_tokens")).alias("_s", "sentence_tokens"))
    rows = rows.select("group", *kept, *text, "_starts", "_s", "sentence_tokens", F.posexplode(listed("sentence_tokens")).alias("_t", "token"))
    rows = rows.select(
        "group",
        *kept,
        F.col("doc_id").cast("string").alias("source_file"),
        F.lit(None).cast("string").alias("section"),
        F.lit(0).cast("bigint").alias("chunk_index"),
        F.col("_s").cast("bigint").alias("sentence_index"),
        F.col("_t").cast("bigint").alias("token_index"),
        token_number(F.get("_starts", F.col("_s")) + F.col("_t")).alias("global_token_index"),
        *([F.get("_texts", F.col("_s")).alias("sentence")] if with_sentence else []),
        *(["sentence_tokens"] if with_tokens else []),
        "token",
    )
    return tagged(rows)


def tagged(rows: DataFrame) -> DataFrame:
    """``rows(token, token_index, ...)`` with ``lemma``, ``upos`` and ``feats``; the lower case is made once a row."""
    low = F.col("_low")
    rows = rows.withColumn("_low", F.lower("token"))  # used so often that it stays a projection of its own
    rows = rows.withColumns({"lemma": lemma_of(F.col("token"), low), "upos": upos_of(F.col("token"), F.col("token_index"), low)})
    return rows.withColumn("feats", feats_of(F.col("token"), F.col("upos"), low)).drop("_low")


def annotate_counts(docs: DataFrame, by: Sequence[str] = (), group: str = "lang") -> DataFrame:
    """Token records summed over what tagging can't tell apart: ``group, by..., token, token_index, n, lemma, upos, feats``.

    The annotator looks at a token and at whether it begins its sentence, so a record
    stands for ``n`` tokens (``token_index`` is 0 or 1) and each distinct form is tagged
    once for each ``by``. Operators that only count take these in place of
    :func:`annotate`; partial sums are made before the one shuffle.
    """
    text = F.rtrim(F.col("text"), F.lit(".!?\n\t\v\f\r "))  # what ends the last sentence marks no token
    found = F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(MARKED), F.lit(0))
    rows = docs.select(F.col(group).alias("group"), *by, F.explode(found).alias("_raw"))
    first = F.left("_raw", F.lit(1)).isin(".", "!", "?", "\n")
    token = F.when(first, F.ltrim(F.col("_raw"), F.lit(".!?\n\t\v\f\r "))).otherwise(F.col("_raw"))
    rows = rows.select("group", *by, token.alias("_form"), F.when(first, 0).otherwise(1).cast("bigint").alias("_at"))
    counts = rows.groupBy("group", *by, "_form", "_at").agg(F.count("*").alias("n"))
    # through n, as Spark else moves filters on tags and joins of lemmas below the sums and tags every token
    own = lambda c: F.when(F.col("n") > 0, F.col(c))
    return tagged(counts.select("group", *by, own("_form").alias("token"), own("_at").alias("token_index"), "n"))


def word_counts(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., token, n`` of the lexical words alone, in one pass; ``by`` are columns of ``docs``."""
    rows = docs.select(*by, F.explode(F.regexp_extract_all("text", F.lit("[\\p{L}\\p{M}\\p{N}]++"), F.lit(0))).alias("token"))
    counts = rows.groupBy(*by, "token").agg(F.count("*").alias("n"))
    return counts.withColumn("token", F.when(F.col("n") > 0, F.col("token"))).filter(F.col("token").rlike(f"^{LEXICAL}$"))  # forms are tested, not words


def chunks(text: str, size: int = CHUNK) -> list[tuple[int, str]]:
    """(start, part) of at most ``size`` characters; cut before white space if there is any, else hard."""
    if size < 1:
        raise ValueError("a chunk needs at least one character")
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            back = end
            while back > at and not text[back].isspace():
                back -= 1
            end = back if back > at else end
        out.append((at, text[at:end]))
        at = end
    return out


_FORM = (
    "doc_id bigint, chunk_index bigint, sentence_index bigint, token_index bigint, place bigint, char_start_in_chunk bigint, "
    "char_end_in_chunk bigint, char_start_in_text bigint, char_end_in_text bigint, sentence string, token string, lemma string, "
    "upos string, feats string"
)


def annotate_with(docs: DataFrame, make: Callable[[], Callable[[str], list]], size: int = CHUNK) -> DataFrame:
    """Token records by any annotator, made once per task by ``make()``.

    The annotator turns a chunk into sentences, lists of dictionaries with ``token``
    and, where known, ``lemma``, ``upos``, ``feats``, ``start`` and ``end``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                place = 0
                for c, (base, part) in enumerate(chunks(text or "", size)):
                    for s, sentence in enumerate(backend(part)):
                        written = " ".join(t["token"] for t in sentence)
                        for k, t in enumerate(sentence):
                            a, b = t.get("start"), t.get("end")
                            known = a is not None and b is not None
                            rows.append((doc, c, s, k, place, a, b, base + a if known else None, base + b if known else None,
                                         written, t["token"], t.get("lemma"), t.get("upos"), t.get("feats") or ""))
                            place += 1
            names = [c.split()[0] for c in _FORM.split(", ")]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({n: "Int64" for n in names if n.startswith("char_")})

    return docs.select("doc_id", "text").mapInPandas(run, _FORM)


def config_tokens(docs: DataFrame, group: str = "lang") -> DataFrame:
    """Tokens without annotation: runs of letters, in one sequence per document."""
    rows = docs.select(F.col(group).alias("group"), "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([\\p{L}\\p{Nl}\\p{No}]+)"), 1)).alias("i", "token"))
    return rows.select(
        "group", F.col("doc_id").cast("string").alias("source_file"), F.lit(None).cast("string").alias("section"),
        F.lit(0).cast("bigint").alias("chunk_index"), F.lit(0).cast("bigint").alias("sentence_index"),
        F.col("i").cast("bigint").alias("token_index"), token_number(F.col("i")).alias("global_token_index"),
        "token", F.lit(True).alias("included"),
    )
