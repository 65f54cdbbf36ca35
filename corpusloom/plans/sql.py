"""SQL of the token table and of what queries share, in the dialect of the checking engine."""

from __future__ import annotations

from ..functions.text import ROMAN
from ..operators.annotate import CLOSED, SUFFIXES

_low = "lower(token)"
_in = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_closed = " ".join(f"WHEN {_low} IN {_in(words)} THEN '{tag}'" for tag, words in CLOSED.items())
_suffix = " ".join(f"WHEN regexp_matches({_low}, '{pattern}') THEN '{tag}'" for tag, pattern in SUFFIXES.items())
_upos = (
    f"CASE WHEN NOT regexp_matches(token, '[\\p{{L}}\\p{{N}}]') THEN 'PUNCT' WHEN regexp_matches(token, '^\\p{{N}}+$') THEN 'NUM' {_closed} "
    f"WHEN token_index > 0 AND regexp_matches(token, '^\\p{{Lu}}') THEN 'PROPN' {_suffix} ELSE 'NOUN' END"
)

TOKENS = f"""WITH sent AS (
  SELECT doc_id, lang, source, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sentence_index
  FROM (SELECT doc_id, lang, source, regexp_split_to_array(text, '[.!?\\n]+') AS s FROM documents)),
toks AS (
  SELECT doc_id, lang, source, sentence_index, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS token_index
  FROM (SELECT *, regexp_extract_all(sentence, '[\\p{{L}}\\p{{M}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}]') AS t FROM sent)),
tagged AS (
  SELECT *, CASE WHEN length(token) > 4 THEN regexp_replace({_low}, 's$', '') ELSE {_low} END AS lemma, {_upos} AS upos FROM toks),
tokens AS (
  SELECT lang AS grp, lang || '_' || source AS work, doc_id, sentence_index, token_index, token, lemma, upos,
         doc_id * 4294967296 + row_number() OVER (PARTITION BY doc_id ORDER BY sentence_index, token_index) - 1 AS gix,
         CASE WHEN upos IN ('NOUN', 'PROPN') THEN (CASE WHEN regexp_matches({_low}, '[aeiou]$') THEN 'Case=Nom' ELSE 'Case=Acc' END)
              || (CASE WHEN {_low} LIKE '%s' THEN '|Number=Plur' ELSE '|Number=Sing' END)
              WHEN upos = 'VERB' THEN 'VerbForm=Fin' ELSE '' END AS feats
  FROM tagged),
lex AS (
  SELECT *, lower(token) AS tv, lower(lemma) AS lv FROM tokens
  WHERE regexp_matches(token, '[\\p{{L}}\\p{{N}}]') AND NOT (regexp_matches({_low}, '{ROMAN}') AND {_low} NOT IN ('di', 'vi'))),
freq AS (SELECT grp AS label, lemma AS item, count(*) AS count FROM tokens WHERE upos = 'NOUN' GROUP BY ALL)"""

CONFIG_TOKENS = """WITH runs AS (
  SELECT lang AS grp, doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS token_index
  FROM (SELECT lang, doc_id, regexp_extract_all(text, '[\\p{L}\\p{Nl}\\p{No}]+') AS t FROM documents))"""


def after(ctes: str, select: str) -> str:
    """Further common tables and the final query behind the tokens."""
    return f"{TOKENS}{',' if ctes else ''}\n{ctes}\n{select}"


def vectors(top: int = 30) -> str:
    """``vec``: shares of the commonest words by work."""
    return f"""mfw AS (SELECT tv AS feature FROM lex GROUP BY tv ORDER BY count(*) DESC, tv LIMIT {top}),
total AS (SELECT work, grp AS author, count(*) AS n FROM lex GROUP BY ALL),
vec AS (
  SELECT t.work, t.author, m.feature, coalesce(c.n, 0) / t.n AS value FROM total t CROSS JOIN mfw m
  LEFT JOIN (SELECT work, tv AS feature, count(*) AS n FROM lex GROUP BY ALL) c ON c.work = t.work AND c.feature = m.feature),
z AS (
  SELECT v.work, v.author, v.feature, (value - m) / s AS value FROM vec v JOIN (
    SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM vec GROUP BY feature HAVING min(value) < max(value)) USING (feature))"""
