"""Quality rules with host verdicts.

Every document is measured and judged by rules; failures are aggregated by host and rule; each host's
rates are shrunk with empirical beta priors; a host that fails a rule surely fails with all its
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, words

#: Fewer words fail; so does a larger share (percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Counted against hosts only: symbols beyond this percent of the words' characters, and repeated lines
#: beyond this percent of the words.
MOST_SYMBOLS, MOST_DUP_LINES = 10, 5
#: A host fails if, SURE posterior deviations below its shrunk rate, it is still above both this share
#: and the rate of the whole corpus.
HOST_RATE, SURE = 0.5, 2.0
#: A prior counts as this many documents at least and at most.
PRIOR_RANGE = (1.0, 1000.0)
RULES = ("few_words", "repeats", "symbols", "dup_lines")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of whole texts.

    A null text has no word and no symbol. Windows of five words are compared by a 64-bit hash
    within their own text. Only a text with a repeated window pays for sorting its windows.
    ``docs`` may not have columns that begin with ``_q_``.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_q_w", words(F.col(text)))
    at = ", ".join(f"_q_w[i + {k}]" for k in range(WINDOW))
    d = d.select(
        *docs.columns,
        F.size("_q_w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_q_w")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_q_lines"),
        F.expr(f"case when size(_q_w) >= {WINDOW} then transform(sequence(0, size(_q_w) - {WINDOW}), i -> xxhash64({at})) else array() end").alias("_q_h"),
    )
    d = d.withColumn("n_dup_lines", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long")).drop("_q_lines")
    d = d.withColumn("_q_s", F.expr("case when size(array_distinct(_q_h)) < size(_q_h) then array_sort(transform(_q_h, (h, i) -> struct(h as h, i as i))) end")).drop("_q_h")
    d = d.withColumn("_q_p", F.expr("array_sort(transform(filter(_q_s, (x, j) -> get(_q_s, j - 1).h <=> x.h or get(_q_s, j + 1).h <=> x.h), x -> x.i))")).drop("_q_s")
    covered = f"aggregate(transform(_q_p, (x, j) -> least({WINDOW}, coalesce(get(_q_p, j + 1) - x, {WINDOW}))), 0, (a, x) -> a + x)"
    return d.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long")).drop("_q_p")


def shrunk_rates(hosts: DataFrame) -> DataFrame:
    """(rule, host, docs, failed) rows -> with ``prior``, ``rate`` and ``spread`` by a beta prior per rule.

    The prior's mean is the corpus rate. Its weight follows from moments of a beta-binomial: the hosts'
    spread beyond what their sizes alone would give, large hosts counting for more; it is kept within
    ``PRIOR_RANGE`` and is the largest where nothing is beyond. ``rate`` and ``spread`` are the mean and
    the standard deviation of a host's posterior: the fewer documents, the nearer to the prior.
    """
    n, k = F.col("docs"), F.col("failed")
    fit = hosts.groupBy("rule").agg(F.count("*").alias("_hosts"), F.sum(n).alias("_n"), F.sum(k).alias("_k"), F.sum(n * n).alias("_n2"), F.sum(k * k / n).alias("_s"))
    p = F.col("_k") / F.col("_n")
    fit = fit.select("rule", p.alias("prior"), (F.col("_hosts") - 1).alias("_free"), (F.col("_n") - F.col("_n2") / F.col("_n") - F.col("_hosts") + 1).alias("_room"), (F.col("_s") - p * p * F.col("_n")).alias("_spread"))
    beyond = (F.try_divide(F.col("_spread"), F.col("prior") * (1 - F.col("prior"))) - F.col("_free")) / F.col("_room")
    weight = F.when((F.col("_room") > 0) & (beyond > 1e-9), 1 / beyond - 1).otherwise(PRIOR_RANGE[1])
    fit = fit.select("rule", "prior", F.greatest(F.lit(PRIOR_RANGE[0]), F.least(weight, F.lit(PRIOR_RANGE[1]))).alias("_weight"))
    d = hosts.join(F.broadcast(fit), "rule")  # a row per rule
    d = d.withColumn("rate", (k + F.col("prior") * F.col("_weight")) / (n + F.col("_weight")))
    return d.withColumn("spread", F.sqrt(F.col("rate") * (1 - F.col("rate")) / (n + F.col("_weight") + 1))).drop("_weight")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, host_failed, kept.

    ``kept`` is false for a document that fails by itself, else false if its host fails any rule. A null
    host is no host: only the document's own rules count. Null and empty texts have few words. Repeated
    rows count and return each time; other columns of ``docs`` are not read; an empty table gives an
    empty result.
    """
    d = measure(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("_host"), F.col(text).alias("_text")), "_text").drop("_text")
    words = F.col("n_words")
    broken = {
        "few_words": words < LEAST_WORDS, "repeats": 100 * F.col("n_repeat_words") > MOST_REPEATED * words,
        "symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars"), "dup_lines": 100 * F.col("n_dup_lines") > MOST_DUP_LINES * words,
    }
    d = cut(d.withColumn("base_failed", broken["few_words"] | broken["repeats"]))
    hosts = d.where(F.col("_host").isNotNull()).groupBy("_host").agg(F.count("*").alias("docs"), *[F.count_if(broken[r]).alias(r) for r in RULES])
    hosts = hosts.unpivot(["_host", "docs"], list(RULES), "rule", "failed")
    worst = shrunk_rates(hosts).where(F.col("rate") - SURE * F.col("spread") > F.greatest("prior", F.lit(host_rate)))
    bad = worst.select("_host", F.lit(True).alias("host_failed")).distinct()
    d = d.join(bad, "_host", "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"),
    )
