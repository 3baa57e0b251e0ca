"""Quality rules: a threshold table compiled into one Spark projection.

Each rule is a row ``(name, numerator, relation, denominator, p, q)`` and
rejects a text when ``q * numerator`` stands in ``relation`` to
``p * denominator``; all terms are whole numbers, so no rounding decides.
The terms are built-in column expressions over one text: lengths, symbols,
stop words, lines and repeated word windows. Nothing is shuffled.

Defined cases: a null or empty text has no words, so it fails the base rules;
a text of white space likewise. Repeated rows are judged alike, an empty table
gives an empty result, and further columns of the input are carried untouched
by ``keep_good`` whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import WS, table

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it was on are as with be by at this from "
    "der die und das den dem des ist nicht ein eine mit auf für von zu sich im auch er "
    "le la les et des est un une que qui dans pour pas sur avec au en du ce il "
    "el los las y que se con por del al su no lo como más para son de"
)

# The symbols that count, as the characters of a regex class.
SYMBOLS = "#*$%&|<>"

#: name, numerator, relation, denominator, p, q: rejected if q * num (relation) p * den.
RULES = (
    ("long_words", "word_chars", ">", "n_words", 15, 1),
    ("short_words", "word_chars", "<", "n_words", 2, 1),
    ("symbols", "n_symbols", ">", "n_words", 1, 10),
    ("few_stop_words", "n_stop_words", "<", "n_words", 1, 50),
    ("repeated_lines", "n_dup_lines", ">", "n_lines", 1, 2),
    ("ellipsis_lines", "n_ellipsis_lines", ">", "n_lines", 3, 10),
    ("bullet_lines", "n_bullet_lines", ">", "n_lines", 9, 10),
    ("shouting", "n_upper", ">", "word_chars", 3, 10),
    ("digits", "n_digits", ">", "word_chars", 3, 10),
)

_RELATIONS = {">": Column.__gt__, "<": Column.__lt__}


def _stop_words() -> list[str]:
    return sorted(set(STOP_WORDS.split()))


def _count(col: Column) -> Column:
    return F.size(col).cast("long")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``(row, m)``: each input row as one struct, and a struct of the whole numbers the rules use.

    With the input in one column, no name of its can clash. The row number in
    ``m`` keeps the optimizer from moving a later filter below the measuring,
    where every term of a condition would repeat it.
    """
    out = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"))
    out = out.withColumn("body", F.coalesce(F.col("row").getField(text), F.lit("")))
    out = out.withColumns(
        {
            "words": F.filter(F.split("body", f"{WS}+"), lambda x: x != ""),
            "lines": F.filter(F.split("body", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        }
    )
    w, n = F.col("words"), F.size("words")
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    out = out.withColumn("hashes", F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window)))
    # Where windows repeat: (hash, place) sorted, so that equal windows become neighbours.
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    out = out.withColumn("grams", F.when(repeats, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    g = F.col("grams")
    same = lambda x, k: F.coalesce(F.get(g, k)["h"] == x["h"], F.lit(False))
    out = out.withColumn("places", F.sort_array(F.transform(F.filter(g, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    # Words covered by repeated windows: each adds what the one before does not cover.
    covered = F.aggregate(
        F.col("places"),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["at"])).alias("n"), x.alias("at")),
        lambda acc: acc["n"].cast("long"),
    )
    b, ln = F.col("body"), F.col("lines")
    stop = _stop_words()
    numbers = {
        "n_words": _count(w),
        "word_chars": F.length(F.translate(b, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": F.regexp_count(b, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": _count(ln) - _count(F.array_distinct(ln)),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        "n_stop_words": _count(F.filter(w, lambda x: F.lower(x).isin(stop))),
        "n_lines": _count(ln),
        "n_ellipsis_lines": _count(F.filter(ln, lambda x: x.endswith("...") | x.endswith("…"))),
        "n_bullet_lines": _count(F.filter(ln, lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("•"))),
        "n_upper": F.regexp_count(b, F.lit("[A-Z]")).cast("long"),
        "n_digits": F.regexp_count(b, F.lit("[0-9]")).cast("long"),
        "at": F.monotonically_increasing_id(),
    }
    return out.select("row", F.struct(*(c.alias(k) for k, c in numbers.items())).alias("m"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def broken(m: Column, rules=RULES) -> list[tuple[str, Column]]:
    """Each rule's name with the condition under which it rejects."""
    return [(name, _RELATIONS[rel](m[num] * q, m[den] * p)) for name, num, rel, den, p, q in rules]


def kept(m: Column, rules=RULES) -> Column:
    return ~reduce(Column.__or__, (c for _, c in broken(m, rules)), base_failed(m))


def score(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Per row of ``df``: doc_id, the numbers, the verdict and the names of the broken rules."""
    m = F.col("m")
    names = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in broken(m, rules))), lambda x: x.isNotNull())
    return measure(df.select("doc_id", text), text).select(
        F.col("row.doc_id").alias("doc_id"),
        *(m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed(m).alias("base_failed"),
        kept(m, rules).alias("kept"),
        F.array_join(names, ",").alias("broken_rules"),
    )


def keep_good(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``df``, columns unchanged, that pass the base rules and every threshold."""
    return measure(df, text).filter(kept(F.col("m"), rules)).select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def _sql_measures(source: str) -> str:
    stop = ", ".join("'" + w + "'" for w in _stop_words())
    ws = "[^\\x20\\x09-\\x0D]"
    return f"""
    split AS (
      SELECT row_number() OVER () AS rid, d.*, coalesce(text, '') AS body,
             regexp_extract_all(coalesce(text, ''), '{ws}+') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{ws}')) AS ls
      FROM {source} d),
    grams AS (
      SELECT rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM split WHERE len(ws) >= 3)),
    twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
    reps AS (
      SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
    measures AS (
      SELECT split.*, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(body, '[{SYMBOLS}]')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
             len(ls) AS n_lines,
             len(list_filter(ls, lambda x: suffix(x, '...') OR suffix(x, '…'))) AS n_ellipsis_lines,
             len(list_filter(ls, lambda x: prefix(x, '- ') OR prefix(x, '* ') OR prefix(x, '•'))) AS n_bullet_lines,
             len(regexp_extract_all(body, '[A-Z]')) AS n_upper,
             len(regexp_extract_all(body, '[0-9]')) AS n_digits
      FROM split LEFT JOIN reps USING (rid)),
    judged AS (
      SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             concat_ws(',', {", ".join(f"CASE WHEN {q} * {num} {rel} {p} * {den} THEN '{name}' END" for name, num, rel, den, p, q in RULES)}) AS broken_rules
      FROM measures)"""


def oracle() -> str:
    return f"""WITH {_sql_measures("documents")}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND broken_rules = '' AS kept, broken_rules
    FROM judged"""
