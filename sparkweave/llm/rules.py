"""Quality rules with verdicts of hosts. DataFrame expressions only.

Every rule's failures are counted by host. A host's rate of a rule is shrunk to a
beta prior that is fitted to all hosts; a host with a rate over the limit takes its
documents with it. Two of the rules reject a document by themselves, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.storage import materialize

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # in 100 words
#: A symbol for so many words, and a repeated line for so many, are too many. These count against the host alone.
WORDS_PER_SYMBOL, WORDS_PER_REPEATED_LINE = 5, 20
HOST_LIMIT = 0.5
#: The prior counts as at least and at most so many documents.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6

_SPACES = "\t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), "")


def _covered(sorted_pairs: Column, n: Column) -> Column:
    """Words inside windows whose hash stands beside an equal one. No lambda refers to a whole array, which Spark would evaluate for each element."""
    none = F.lit(None).cast("struct<h:bigint,i:int>")
    before = F.concat(F.array(none), F.slice(sorted_pairs, 1, n - 1))
    after = F.concat(F.slice(sorted_pairs, 2, n - 1), F.array(none))
    flagged = F.zip_with(
        F.zip_with(
            sorted_pairs, before, lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), (a["h"].eqNullSafe(b["h"])).alias("f"))
        ),
        after,
        lambda a, c: F.when(a["f"] | a["h"].eqNullSafe(c["h"]), a["i"]),
    )
    return F.aggregate(
        F.sort_array(F.filter(flagged, lambda i: i.isNotNull())),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("words")),
        lambda acc, i: F.struct(i.alias("last"), (acc["words"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("words")),
        lambda acc: acc["words"],
    )


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the counts that the rules judge.

    Words of repeated windows are found inside a row: windows are hashed (XXH64
    of their eight words), and only where two hashes of a text are equal are they
    sorted to see which. A null text has no words and no lines.
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    step = docs.withColumnRenamed(text_col, "__text").withColumn("__text", text)
    step = step.withColumn("__words", words(F.col("__text")))
    step = step.withColumn("n_words", F.size("__words").cast("long"))
    step = step.withColumn(
        "__hashes",
        F.when(
            F.size("__words") > WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("__words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("__words"), i, WINDOW))
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    step = step.withColumn(
        "__pairs",
        F.when(
            F.size(F.array_distinct("__hashes")) < F.size("__hashes"),
            F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumn("__lines", lines)
    return (
        step.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn(
            "n_repeat_words",
            F.when(F.col("__pairs").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("__pairs"), F.size("__pairs"))),
        )
        .drop("__text", "__words", "__hashes", "__pairs", "__lines")
    )


def rules() -> dict[str, Column]:
    """Whether a document fails each of the rules, from its counts."""
    return {
        "few_words": F.col("n_words") < MIN_WORDS,
        "repeated_words": 100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"),
        "symbols": WORDS_PER_SYMBOL * F.col("n_symbols") > F.col("n_words"),
        "repeated_lines": WORDS_PER_REPEATED_LINE * F.col("n_dup_lines") > F.col("n_words"),
    }


def base_failed() -> Column:
    known = rules()
    return known["few_words"] | known["repeated_words"]


def prior(n: int, f: int, hosts: int, squares: float, spread: float) -> tuple[float, float]:
    """Mean and strength of the beta prior, by moments.

    ``n`` documents of ``hosts`` hosts failed ``f`` times; ``squares`` is the sum of
    n_h**2, ``spread`` that of f_h**2 / n_h. What binomial sampling alone would spread
    the hosts' rates by is subtracted: hosts that differ by chance only have a prior as
    strong as can be, however small they are.
    """
    mean = f / n
    each = mean * (1 - mean)
    room = each * (n - squares / n - (hosts - 1))
    beyond = spread - mean * mean * n - each * (hosts - 1)
    if room <= 0 or beyond <= 0:
        return mean, MOST_STRENGTH
    return mean, min(max(room / beyond - 1, LEAST_STRENGTH), MOST_STRENGTH)


def host_rates(judged: DataFrame, host_col: str, failed_cols: list[str]) -> DataFrame:
    """(host, n_docs, n_<rule>, rate_<rule>): failures and shrunk rates of each of ``failed_cols`` (a null one hasn't failed).

    The prior's mean is the rate over all documents. Only the sums that the priors
    follow from reach the driver.
    """
    counts = [F.count_if(F.col(c)).alias(f"n_{c}") for c in failed_cols]
    hosts = judged.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), *counts)
    hosts = materialize(hosts, "hosts")
    of_each = [a for c in failed_cols for a in (F.sum(f"n_{c}").alias(f"f_{c}"), F.sum(F.col(f"n_{c}") * F.col(f"n_{c}") / F.col("n_docs")).alias(f"s_{c}"))]
    squares = F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("squares")
    sums = hosts.agg(F.sum("n_docs").alias("n"), F.count("*").alias("hosts"), squares, *of_each).first()
    for c in failed_cols:
        if sums["n"]:
            mean, strength = prior(sums["n"], sums[f"f_{c}"], sums["hosts"], sums["squares"], sums[f"s_{c}"])
            rate = (F.col(f"n_{c}") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
        hosts = hosts.withColumn(f"rate_{c}", rate if sums["n"] else F.lit(0.0))
    return hosts


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = HOST_LIMIT
) -> DataFrame:
    """One row for each row of ``docs``: its id, the counts, ``base_failed``, ``host_rate`` and ``kept``.

    ``host_rate`` is the largest of the host's shrunk failure rates. A document stays
    if it passes the base rules and that isn't over ``host_limit``: of what the host
    has, more fails a rule than passes it. A null host has no verdict, so its
    documents are judged by the base rules alone (``host_rate`` null). Rows that
    repeat an id are judged each for itself. No rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("__host"), F.col(text_col).alias("text"))
    judged = materialize(measure(rows).withColumn("base_failed", base_failed()), "judged")
    names = list(rules())
    rates = host_rates(judged.select("__host", *(c.alias(n) for n, c in rules().items())), "__host", names)
    rates = rates.select(F.col("host").alias("__host"), F.greatest(*(f"rate_{n}" for n in names)).alias("host_rate"))
    return (
        judged.join(rates, "__host", "left")
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= host_limit))
        .drop("__host")
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
ln AS (SELECT rid, x FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dl AS (SELECT rid, sum(n - 1) AS n_dup FROM (SELECT rid, x, count(*) AS n FROM ln GROUP BY rid, x) GROUP BY rid),
win AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS s FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, sum(least(8, i - coalesce(p, i - 8))) AS n_rep FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM rep) GROUP BY rid),
m AS (
  SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dl USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
x AS (
  SELECT source, unnest(['few', 'repeats', 'symbols', 'lines']) AS rule,
    unnest([n_words < 20, 100 * n_repeat_words > 30 * n_words, 5 * n_symbols > n_words, 20 * n_dup_lines > n_words]) AS bad
  FROM b WHERE source IS NOT NULL),
h AS (SELECT source, rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE bad) AS DOUBLE) AS f FROM x GROUP BY source, rule),
mu AS (SELECT rule, sum(f) / sum(n) AS m, sum(n) AS total, count(*) AS hosts, sum(n * n) AS squares FROM h GROUP BY rule),
v AS (SELECT rule, sum(n * power(f / n - m, 2)) - any_value(m * (1 - m) * (hosts - 1)) AS beyond, any_value(m * (1 - m) * (total - squares / total - hosts + 1)) AS room FROM h JOIN mu USING (rule) GROUP BY rule),
p AS (SELECT rule, m, CASE WHEN room > 0 AND beyond > 0 THEN least(greatest((room - beyond) / beyond, 1.0), 1e6) ELSE 1e6 END AS k FROM mu JOIN v USING (rule)),
r AS (SELECT source, max((f + m * k) / (n + k)) AS rate FROM h JOIN p USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(rate, 0.0) <= 0.5 AS kept
FROM b LEFT JOIN r USING (source)
"""
