"""Quality rules per document and per host, with DataFrame functions only.

A document's base rules are counted in its own row. Rule failures are then summed by host, each host's failure rates
are shrunk towards a beta prior that is fitted to all hosts, and the host's verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidgraph.llm.shared import SPACES, table, words, written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Rules that a host is judged by, over a document's counts.
RULES = {
    "few_words": "n_words < 50",
    "repeated": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
}

#: The counts of a document.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

# A one-element array passed to transform() binds a value to a name: it is computed once for a row.
_REPEATED = """
element_at(transform(array({words}), w -> aggregate(sort_array(filter(element_at(transform(array(
    sort_array(transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> struct(concat_ws(' ', x, get(w, i + 1), get(w, i + 2)) AS t, i AS i)))
  ), s -> transform(s, (e, j) -> if(e.t <=> get(s, j - 1).t OR e.t <=> get(s, j + 1).t, e.i, null))), 1), p -> p IS NOT NULL)),
  named_struct('n', 0L, 'last', -3),
  (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p),
  a -> a.n)), 1)
"""


def counts(text: Column) -> dict[str, Column]:
    """The counts of one text; null counts as a text without words."""
    body = F.coalesce(text, F.lit(""))
    # a line without a word has no character but white space
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return {
        "n_words": F.size(words(text)).cast("long"),
        "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def document_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts, n_repeat_words and base_failed. Columns of these names in ``docs`` are replaced.

    Words in 3-word windows found twice: the windows of a text are sorted with their places, equal neighbours are
    repeated, and each repeated place adds the words that the place before it does not cover already.
    """
    base = docs.drop(*[c for c in (*COUNTS, "base_failed", "_words") if c != text])
    rows = base.withColumn("_words", words(F.col(text)))
    measured = counts(F.col(text)) | {"n_words": F.size("_words").cast("long"), "n_repeat_words": F.expr(_REPEATED.format(words="_words")).cast("long")}
    rows = rows.withColumns(measured).drop("_words")
    return rows.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """(alpha, beta) for each rule by the method of moments over all hosts: one row comes to the driver.

    The variance of the hosts' rates, less what counting alone explains, gives the prior's strength, held between 1
    and 1000 documents. Without rows the prior is (0.5, 0.5).
    """
    means = hosts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), *[F.sum(r).alias(r) for r in RULES]).first()
    if not means["n"]:
        return {r: (0.5, 0.5) for r in RULES}
    mean = {r: means[r] / means["n"] for r in RULES}
    spread = hosts.agg(*[F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - F.lit(mean[r]), 2)).alias(r) for r in RULES]).first()
    priors = {}
    for r, m in mean.items():
        between = spread[r] / means["n"] - m * (1 - m) * means["hosts"] / means["n"]
        strength = min(1000.0, max(1.0, m * (1 - m) / max(between, 1e-9) - 1))
        priors[r] = (m * strength, (1 - m) * strength)
    return priors


def host_verdicts(rows: DataFrame, host: str, limit: float) -> DataFrame:
    """One row per host with its shrunk rates; ``host_failed`` if any rate is above ``limit``."""
    flags = {r: F.sum(F.expr(f"CAST(coalesce({rule}, false) AS BIGINT)")).alias(r) for r, rule in RULES.items()}
    hosts = written(rows.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("n"), *flags.values()), "hosts")
    rates = {r: (F.col(r) + F.lit(a)) / (F.col("n") + F.lit(a + b)) for r, (a, b) in beta_priors(hosts).items()}
    verdict = hosts.select("_host", *[rate.alias(f"rate_{r}") for r, rate in rates.items()])
    return verdict.withColumn("host_failed", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > F.lit(limit))


def judge(docs: DataFrame, host: str = "source", text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` without the text, with their counts, base_failed, the host's shrunk rates, host_failed and
    kept, which take the place of columns of their names.

    ``kept``: no base rule failed and the host's shrunk failure rates are ``limit`` at most. Null text: no words, so it
    fails. Null hosts form one host. Repeated rows count each. Empty table: empty result. The counts are written once
    to the shared folder, as both the hosts' sums and the join read them; the join moves counts, never texts, and a
    host that has a third of the rows is split by adaptive execution.
    """
    own = [c for c in docs.columns if c != text]
    # the caller's columns travel in one, so that no name clashes
    apart = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(host).alias("_of"), F.col(text).alias("_text"))
    rows = written(document_rules(apart, "_text").drop("_text"), "rule-counts")
    hosts = host_verdicts(rows, "_of", limit)
    joined = rows.join(hosts, rows["_of"].eqNullSafe(hosts["_host"]), "left")
    joined = joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False)))
    new = [*COUNTS, "base_failed", *[f"rate_{r}" for r in RULES], "host_failed", "kept"]
    return joined.select(*[joined["_row"][c].alias(c) for c in own if c not in new], *new)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_FLAGS = ", ".join(f"CAST(sum(CASE WHEN {rule} THEN 1 ELSE 0 END) AS DOUBLE) AS {r}" for r, rule in RULES.items())
_MEANS = ", ".join(f"sum({r}) / sum(n) AS m_{r}" for r in RULES)
_SPREADS = ", ".join(
    f"least(1000.0::DOUBLE, greatest(1.0::DOUBLE, m_{r} * (1 - m_{r}) / greatest((SELECT sum(n * pow({r} / n - m_{r}, 2)) FROM h) / total - m_{r} * (1 - m_{r}) * hosts / total, 1e-9::DOUBLE) - 1)) AS k_{r}"
    for r in RULES
)
_RATES = ", ".join(f"({r} + m_{r} * k_{r}) / (n + k_{r})" for r in RULES)
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
ws AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
              list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, text FROM d),
tri AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM ws WHERE len(w) >= 3),
t AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM tri),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM t) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
c AS (SELECT d.doc_id, d.source, len(w) AS n_words, length(regexp_replace(ws.text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(ws.text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM d JOIN ws USING (rid) LEFT JOIN rep USING (rid)),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, {_FLAGS} FROM c GROUP BY source),
m AS (SELECT sum(n) AS total, CAST(count(*) AS DOUBLE) AS hosts, {_MEANS} FROM h),
k AS (SELECT *, {_SPREADS} FROM m),
v AS (SELECT source, greatest({_RATES}) > 0.5::DOUBLE AS host_failed FROM h CROSS JOIN k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT host_failed AS kept
FROM c JOIN v ON c.source IS NOT DISTINCT FROM v.source
"""
