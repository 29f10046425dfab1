"""Quality rules judged per host: failure rates shrunk by an empirical beta prior, joined back to documents.

A document that fails a base rule goes.  The stricter rules are no ground by themselves, as a clean
document may fail one by chance.  How far a document is beyond a strict limit, counted in limits, gives
the odds against it; the host's odds of failing over those of the prior's mean are the prior they are
multiplied with.  So an ordinary host loses what is twice over a limit, a host with many failures what
is barely over it, and a clean host only what is far beyond.  Where a host's shrunk failure rate says
that such documents are what it mostly has, every strict failure counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quotalens.llm.store import saved
from quotalens.llm.text_stats import text_stats

#: A host is bad under a rule when its shrunk failure rate is above this: its strict failures go whatever their odds.
BAD_RATE = 0.5


def rules() -> dict[str, Column]:
    """Rule name to whether a document fails it.  All in whole numbers."""
    words = F.col("n_words")
    return {
        "base": (words < 20) | (100 * F.col("n_repeat_words") > 30 * words),
        "symbols": 10 * F.col("n_symbols") > words,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 15 * words),
    }


def excess() -> dict[str, Column]:
    """Strict rule name to how far a document is beyond the limit, in limits; 0 at the limit itself."""
    words, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    over = {
        "symbols": 10 * F.col("n_symbols") / words,
        "dup_lines": 10 * F.col("n_dup_lines") / (3 * F.col("n_lines")),
        "word_length": F.greatest(2 * words / chars, chars / (15 * words)),
    }
    return {name: times - 1 for name, times in over.items()}


def beta_prior(hosts: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Alpha and beta for each rule, by moments over the hosts' rates.  One row reaches the driver."""
    parts = [F.count("*").alias("hosts"), F.sum("n").alias("n")]
    for name in names:
        rate = F.col(name) / F.col("n")
        parts += [F.avg(rate).alias(f"mean_{name}"), F.var_samp(rate).alias(f"var_{name}")]
    row = hosts.agg(*parts).first()
    out = {}
    for name in names:
        mean, var = row[f"mean_{name}"], row[f"var_{name}"]
        if mean is None:
            out[name] = (0.5, 0.5)
            continue
        mean = min(max(mean, 1e-3), 1 - 1e-3)
        average = row["n"] / row["hosts"]
        weight = mean * (1 - mean) / var - 1 if var else average  # equal rates: the prior weighs as much as a host
        weight = min(max(weight, 1.0), max(average, 1.0))
        out[name] = (mean * weight, (1 - mean) * weight)
    return out


def host_verdicts(stats: DataFrame, host: str = "host", bad_rate: float = BAD_RATE) -> DataFrame:
    """Per host: n, failures, shrunk rate of each rule, bad_<rule>, and odds_<rule>, the host's odds over those of the prior's mean."""
    failed = rules()
    hosts = stats.groupBy(host).agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(name) for name, c in failed.items()])
    hosts = saved(hosts, "hosts")
    prior = beta_prior(hosts, list(failed))
    for name, (alpha, beta) in prior.items():
        rate = (F.col(name) + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
        hosts = hosts.withColumn(f"rate_{name}", rate).withColumn(f"bad_{name}", rate > bad_rate)
        hosts = hosts.withColumn(f"odds_{name}", (F.col(name) + F.lit(alpha)) / (F.col("n") - F.col(name) + F.lit(beta)) * F.lit(beta / alpha))
    return hosts


def judge(docs: DataFrame, host: str = "source", bad_rate: float = BAD_RATE) -> DataFrame:
    """Counts and verdict for each document.

    ``docs`` needs doc_id, text and the host column; other columns are ignored.  Returns per row doc_id,
    text_key (xxhash64 of the text), host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_bad (under some
    stricter rule that the document fails itself, by the odds or because most of the host fails it or the base rules) and kept.
    More base failures than the prior's mean raise a host's odds under every strict rule; fewer do not lower them.  A null text has no words and so fails the
    base rules, as does an empty one.  A null host is a host of its own.  Repeated rows are judged one by
    one.  A null doc_id stays null.  An empty table gives an empty table.
    """
    stats = saved(text_stats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text"), ["doc_id", "host", "text_key"])
                  .withColumnsRenamed({"key_0": "doc_id", "key_1": "host", "key_2": "text_key"}), "stats")
    failed = rules()
    verdicts = host_verdicts(stats, "host", bad_rate).select(F.col("host").alias("of_host"), *[f"{kind}_{name}" for name in failed for kind in ("bad", "odds")])
    joined = stats.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")), "left")
    strict = F.lit(False)
    for name, beyond in excess().items():
        odds = beyond * F.col(f"odds_{name}") * F.greatest(F.lit(1.0), F.col("odds_base"))
        against = F.coalesce(F.round(odds, 9) >= 1, F.lit(False))  # rounded: the last bits follow the order of the hosts
        strict = strict | (failed[name] & (F.col(f"bad_{name}") | F.col("bad_base") | against))
    return (
        joined.withColumn("base_failed", failed["base"]).withColumn("host_bad", F.coalesce(strict, F.lit(False)))
        .select("doc_id", "text_key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_bad", (~F.col("base_failed") & ~F.col("host_bad")).alias("kept"))
    )
