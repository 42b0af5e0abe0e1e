"""Host-level quality rules, in DataFrame functions only.

Each document is measured and judged by several rules. Failures of each rule are added up by host
(`source`), and a host's failure rate is shrunk towards a beta prior that is fitted to all hosts, rule by
rule. A host is strict in a rule if its shrunk rate lies above what the prior lets expect; documents of that host
that fail the rule are dropped, while elsewhere a single failure is forgiven. A host most of whose
documents fail the base rules loses all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.util import materialize

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"


def split_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, [] for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words (long) of every whole text.

    Equal 3-word windows are found by sorting (hash, position) inside the row: no row leaves its
    partition, and a long text costs n log n.
    """
    d = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    d = d.select(
        *keep,
        split_words(F.col("_t")).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        F.length(F.regexp_replace("_t", SYMBOLS, "")).cast("long").alias("n_symbols"),
    )
    windows = F.transform(
        F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("p")),
    )
    d = d.select(
        *keep, "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.sort_array(windows).alias("_s"),
    )
    twice = F.filter("_s", lambda x, i: (F.get("_s", i + 1)["h"] == x["h"]) | (F.get("_s", i - 1)["h"] == x["h"]))
    d = d.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["p"])))
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


#: Rules that a host is judged by: the base rules, and the measures that only count where the host is known for them.
RULES = {
    "base": "n_words < 50 or 100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}


def host_rates(judged: DataFrame, host: str = "source") -> DataFrame:
    """(host, n, and per rule fails_, rate_, limit_): failures of judged(host, fail_<rule>...), rates shrunk by a beta prior fitted to all hosts by moments.

    A prior's mean is the pooled rate; its strength follows from the spread of the hosts' rates, and
    stays between 1 and 1000 documents. limit_ is the prior's mean and one standard deviation.
    Documents without a host form one host of their own.
    """
    hosts = materialize(judged.groupBy(host).agg(F.count("*").alias("n"), *[F.count_if(f"fail_{r}").alias(f"fails_{r}") for r in RULES]), "hosts")
    sums = [x for r in RULES for x in (F.sum(f"fails_{r}").alias(f"f_{r}"), F.sum(F.col(f"fails_{r}") * F.col(f"fails_{r}") / F.col("n")).alias(f"s_{r}"))]
    total = hosts.agg(F.sum("n").alias("n"), *sums).first()  # one row
    for r in RULES:
        n = total["n"] or 1
        mean = (total[f"f_{r}"] or 0) / n
        spread = max((total[f"s_{r}"] or 0.0) / n - mean * mean, 0.0)
        strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1000.0) if spread > 0 else 1000.0
        rate = (F.col(f"fails_{r}") + F.lit(strength * mean)) / (F.col("n") + F.lit(strength))
        hosts = hosts.withColumn(f"rate_{r}", rate).withColumn(f"limit_{r}", F.lit(mean + (mean * (1 - mean) / (strength + 1)) ** 0.5))
    return hosts


def host_rules(docs: DataFrame, limit: float = 0.5) -> DataFrame:
    """doc_id, source, the measures, fail_<rule> of each rule, base_failed, rate (the host's shrunk rate of base failures), kept.

    kept: the base rules are met, the host's rate is at most `limit`, and no rule fails in which the host's
    shrunk rate lies above the rule's own limit. Null or empty texts have zero words and fail. One row per input row, repeated
    rows too; an empty table gives an empty result. Other columns are ignored.
    """
    measured = measures(docs).select("*", *[F.expr(rule).alias(f"fail_{r}") for r, rule in RULES.items()])
    judged = materialize(measured.withColumn("base_failed", F.col("fail_base")), "judged")
    strict = [(F.col(f"rate_{r}") > F.col(f"limit_{r}") + 1e-9).alias(f"strict_{r}") for r in RULES]
    rates = materialize(host_rates(judged).select(F.col("source").alias("_host"), F.col("rate_base").alias("rate"), *strict), "rates")
    out = judged.join(rates, F.col("source").eqNullSafe(F.col("_host")), "left").drop("_host")
    kept = ~F.col("base_failed") & (F.col("rate") <= limit)
    for r in RULES:
        kept &= ~(F.col(f"fail_{r}") & F.col(f"strict_{r}"))
    return out.withColumn("kept", kept).drop(*[f"strict_{r}" for r in RULES])


def op3_quality(spark, sf_dir: str) -> DataFrame:
    out = host_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
tri AS (SELECT doc_id, i AS p, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT doc_id, p FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (SELECT doc_id, sum(least(3, coalesce(nxt - p, 3))) AS n
        FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w) w
      LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS f1, 10 * n_symbols > n_words AS f2, word_chars < 3 * n_words OR word_chars > 10 * n_words AS f3, 10 * n_dup_lines > 3 * n_lines AS f4 FROM m),
h AS (SELECT source, unnest([1, 2, 3, 4]) AS rule, count(*) AS n, unnest([count(*) FILTER (f1), count(*) FILTER (f2), count(*) FILTER (f3), count(*) FILTER (f4)]) AS f FROM j GROUP BY source),
a AS (SELECT rule, sum(f) / sum(n) AS mean, greatest(sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)), 0) AS spread FROM h GROUP BY rule),
k AS (SELECT rule, mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1), 1000) ELSE 1000 END AS s FROM a),
r AS (SELECT source, rule, (f + s * mean) / (n + s) AS rate, mean + sqrt(mean * (1 - mean) / (s + 1)) + 1e-9 AS most FROM h JOIN k USING (rule)),
v AS (SELECT source, max(rate) FILTER (rule = 1) <= 0.5 AS fine, bool_or(rate > most) FILTER (rule = 2) AS s2, bool_or(rate > most) FILTER (rule = 3) AS s3, bool_or(rate > most) FILTER (rule = 4) AS s4 FROM r GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 AS base_failed, (NOT f1 AND fine AND NOT (f2 AND s2) AND NOT (f3 AND s3) AND NOT (f4 AND s4)) AS kept
FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source
"""
