"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document.  The ledger keeps the measurements and one failure
bit per rule; a policy is a versioned mask over these bits, so applying another policy, or
asking what a rule alone removes, never touches the texts again.

Defined results: a null or blank text has no words and fails `few_words`; repeated rows get
equal results; an empty table gives an empty ledger; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, pick, table

#: name -> failure condition over the measurements.  The position is the bit; new rules go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines",
    "shouting": "2 * n_upper > word_chars",
    "exclamations": "10 * n_bangs > n_words",
    "long_words": "word_chars > 20 * n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}


def mask_of(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: Policies only ever gain versions; what an old one rejected stays reproducible from the ledger.
POLICIES: dict[str, int] = {
    "v1": mask_of("few_words", "repeated_windows"),
    "v2": mask_of(*RULES),
}
BASE, CURRENT = "v1", "v2"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]


def _count(text: Column, keep: str) -> Column:
    """How many characters of the class `keep` a text has."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


def measured(docs: DataFrame, text: Column) -> DataFrame:
    """`docs` with the measurements of `text` as columns `_m_*`.

    Words in windows that occur twice: hash each window of three words to 64 bits, and only if
    some hash repeats, sort (hash, place), keep places whose neighbour has the same hash, and
    add up what the sorted places cover.  n log n in the words of one text, whatever repeats.

    The measurements go through a generator of one row: the optimizer would push a caller's filter
    below plain columns and write each of them out at every use, which never ends.
    """
    t = F.coalesce(text, F.lit(""))
    df = docs.withColumn("_t", t)
    df = df.withColumn("_b", F.btrim("_t", F.lit(" \t\n\x0b\x0c\r")))
    df = df.withColumn("_w", F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.split("_b", f"[{SPACES}]+")))
    df = df.withColumn("_n", F.size("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    df = df.withColumn("_l", lines)
    windows = F.expr("transform(slice(_w, 1, greatest(_n - 2, 0)), (x, i) -> xxhash64(x, _w[i + 1], _w[i + 2]))")
    df = df.withColumn("_h", windows)
    df = df.withColumn("_s", F.expr(
        "CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (x, i) -> struct(x AS h, i AS i))) END"))
    df = df.withColumn("_p", F.expr(
        "sort_array(transform(filter(_s, (x, k) -> coalesce(x.h = get(_s, k - 1).h, false) OR coalesce(x.h = get(_s, k + 1).h, false)), x -> x.i))"))
    covered = F.expr("coalesce(3 + aggregate(zip_with(slice(_p, 2, greatest(size(_p) - 1, 0)), slice(_p, 1, greatest(size(_p) - 1, 0)), (b, a) -> least(3, b - a)), 0, (s, x) -> s + x), 0)")
    values = {
        "_m_n_words": F.col("_n").cast("long"),
        "_m_word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "_m_n_symbols": _count(F.col("_t"), "#*$%&|<>"),
        "_m_n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_m_n_repeat_words": covered.cast("long"),
        "_m_n_lines": F.size("_l").cast("long"),
        "_m_n_upper": _count(F.col("_t"), "\\p{Lu}"),
        "_m_n_bangs": (F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit("")))).cast("long"),
    }
    df = df.withColumn("_m", F.explode(F.array(F.struct(*[c.alias(n) for n, c in values.items()]))))
    return df.withColumns({n: F.col("_m")[n] for n in values}).drop("_m", "_t", "_b", "_w", "_n", "_l", "_h", "_s", "_p")


def ledger(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """doc_id, every measurement, and fail_bits: bit k is set if rule k fails."""
    m = measured(pick(docs, "doc_id", "text"), F.col("text"))
    m = m.select("doc_id", *[F.col(f"_m_{n}").alias(n) for n in MEASURES])
    return m.withColumn("fail_bits", _bits(rules))


def _bits(rules: dict[str, str]) -> Column:
    parts = [F.when(F.expr(cond), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, cond in enumerate(rules.values())]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def apply_policy(book: DataFrame, version: str = CURRENT, to: str = "kept") -> DataFrame:
    """`book` with a boolean column: no rule of the policy failed."""
    return book.withColumn(to, F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """rule, n_failed, n_only: documents that a rule rejects, and those that it alone rejects under the policy.

    The ledger is first added up by its masked bits (2 ** rules groups at most, partial sums on
    the map side), so the rest works on a table whose size doesn't follow the input.
    """
    mask = POLICIES[version]
    by_bits = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(name, bit) for name, bit in BIT.items() if bit & mask]
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rules])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (by_bits.select("bits", "n", named)
            .groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
                 F.bit_or("bits").alias("seen_bits")))


def keep_good(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of `docs` that pass a policy, unchanged.  One pass, no join, so repeated or missing ids don't matter."""
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    m = measured(flat, F.col(f"_c{names.index('text')}")).withColumnsRenamed({f"_m_{n}": n for n in MEASURES})
    kept = m.where(_bits(RULES).bitwiseAND(F.lit(POLICIES[version])) == 0)
    return kept.select(*[f"_c{i}" for i in range(len(names))]).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(POLICIES[BASE])) != 0).alias("base_failed"), "kept", "fail_bits")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
w AS (SELECT row, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT row, i, count(*) OVER (PARTITION BY row, w[i], w[i + 1], w[i + 2]) AS c
      FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT row, count(DISTINCT i + k) AS n FROM g, range(0, 3) AS s(k) WHERE c > 1 GROUP BY row),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(l) AS n_lines, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_bangs
      FROM w LEFT JOIN r USING (row)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
      + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
      + CASE WHEN 2 * n_upper > word_chars THEN 16 ELSE 0 END + CASE WHEN 10 * n_bangs > n_words THEN 32 ELSE 0 END
      + CASE WHEN word_chars > 20 * n_words THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_quality_rules": query}
ORACLES = {"op4_quality_rules": SQL}
