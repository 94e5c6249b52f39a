"""Host-level quality rules (operator 11). DataFrame and SQL functions only.

Every document is measured and held against five rules, two of them base rules that drop it outright. Failures are
then summed by host (the document's ``source``), each rule's failure rate on a host is shrunk towards the corpus with a
beta prior fitted to the hosts, and the hosts' verdicts are joined back:

* a host whose shrunk rate of documents failing any rule is above ``REJECT`` loses all its documents;
* on a host whose shrunk rate of one rule is above ``SUSPECT``, documents failing that rule go; elsewhere a single
  failure of a rule that is not a base rule is let pass.

The prior of a rule has the corpus rate as its mean; its strength in documents follows from how far the hosts' rates lie
apart beyond what chance explains (moments), between ``LEAST_STRENGTH`` and ``MOST_STRENGTH``. A host of few documents is
thus judged mostly by the corpus, one of many by itself.

Measuring happens inside the row: windows of three words are sorted with their places, equal neighbours are repeats, so
a text costs n log n. Narrow rows of numbers are settled, sums per host are partially aggregated, and the join back has
one row per host on one side, so a host with a third of all rows is one row a task in the only shuffle.

Defined cases: null is the empty text, which fails for its few words; a null source is a host of its own; repeated rows
are measured and counted each; lines and windows are compared as they are, without folding case; an empty table gives an
empty result; a corpus of one host has a prior of the greatest strength; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09\x0A\x0B\x0C\x0D]++"  # what stands between words
NO_SYMBOL = r"[^#*$%&|<>]++"
WINDOW = 3
REJECT, SUSPECT = 0.5, 0.2
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
# Rules as conditions over the measures in whole numbers; the first two are the base rules.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "same_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}
BASE = ("few_words", "repeats")


_PLACE = 30  # bits of a window's place in its key: a text of 2 GB has fewer words


def _repeat_words(words: str) -> Column:
    """Words that lie in a window of three found twice or more; ``words`` is an array column.

    Keys of 34 hash bits and a place are sorted as whole numbers; windows that share the bits with a neighbour are
    compared as texts. Each array is bound to a name by a ``transform`` of a one-element array, so that it is made once.
    """
    def neighbours(equal: str) -> str:  # is element i equal to i + 1, for all i; the last one is not
        return f"zip_with(s, slice(s, 2, greatest(size(s) - 1, 0)), (a, b) -> coalesce({equal}, false))"

    def touched(pick: str) -> str:
        return f"sort_array(filter(transform(s, (x, i) -> if(e[i] OR (i > 0 AND e[greatest(i - 1, 0)]), {pick}, null)), i -> i IS NOT NULL))"

    def bound(value: str, name: str, inner: str) -> str:
        return f"transform(array({value}), {name} -> {inner})[0]"

    keys = f"sort_array(transform(slice(w, 1, greatest(size(w) - {WINDOW - 1}, 0)), " \
           f"(x, i) -> (xxhash64(x, w[i + 1], w[i + 2]) & {-1 << _PLACE}L) | i))"
    alike = bound(neighbours(f"shiftright(a ^ b, {_PLACE}) = 0"), "e", touched(f"cast(x & {(1 << _PLACE) - 1}L as int)"))
    texts = f"sort_array(transform({bound(keys, 's', alike)}, i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g, i AS i)))"
    places = bound(texts, "s", bound(neighbours("a.g = b.g"), "e", touched("x.i")))
    covered = f"aggregate(zip_with(r, slice(r, 2, greatest(size(r) - 1, 0)), (a, b) -> least(coalesce(b - a, {WINDOW}), {WINDOW})), 0L, (n, d) -> n + d)"
    return F.expr(bound(words, "w", bound(places, "r", covered)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, the measures, and one boolean for each rule."""
    text, joined, lines = F.col("text"), F.col("joined"), F.col("lines")
    spaced = docs.select("doc_id", F.col("source").alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("text")) \
        .withColumn("joined", F.trim(F.regexp_replace(text, SPACE, " ")))
    split = spaced.select(
        "doc_id", "host", F.length(joined).cast("long").alias("size"), F.when(joined == "", F.array().cast("array<string>"))
        .otherwise(F.split(joined, " ", -1)).alias("words"),
        F.length(F.regexp_replace(text, NO_SYMBOL, "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("lines"))
    n_words, n_lines = F.size("words").cast("long"), F.size(lines).cast("long")
    return split.select(
        "doc_id", "host", n_words.alias("n_words"), (F.col("size") - F.greatest(n_words - 1, F.lit(0))).alias("word_chars"),
        "n_symbols", n_lines.alias("n_lines"), (n_lines - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        _repeat_words("words").alias("n_repeat_words")
    ).select("*", *[F.expr(rule).alias(name) for name, rule in RULES.items()])


def priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and strength of each rule's beta prior, from one row of sums over ``hosts`` (host, n, f_...)."""
    kinds = [*RULES, "any"]
    total = hosts.agg(F.sum("n"), F.count("*"), *[F.sum(f"f_{k}") for k in kinds]).first()
    if not total[1]:
        return {k: (0.0, MOST_STRENGTH) for k in kinds}
    mean = {k: t / total[0] for k, t in zip(kinds, total[2:])}
    rate = {k: F.col(f"f_{k}") / F.col("n") - F.lit(mean[k]) for k in kinds}
    spread = hosts.agg(*[F.sum(F.col("n") * rate[k] * rate[k]) for k in kinds]).first()
    out = {}
    for k, v in zip(kinds, spread):
        chance = mean[k] * (1 - mean[k])
        apart = (v - chance * (total[1] - 1)) / total[0]  # the hosts' variance less that of chance
        strength = chance / apart - 1 if apart > 0 else MOST_STRENGTH
        out[k] = mean[k], max(LEAST_STRENGTH, min(MOST_STRENGTH, strength))
    return out


def host_rates(rows: DataFrame) -> DataFrame:
    """host, n and the shrunk failure rate of each rule and of ``any``: one row per host of ``rows`` (measured)."""
    failed = rows.withColumn("any", reduce(or_, [F.col(r) for r in RULES]))
    hosts = written(failed.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(k).alias(f"f_{k}") for k in (*RULES, "any")]), "host-sums")
    shrunk = [((F.col(f"f_{k}") + F.lit(m * s)) / (F.col("n") + F.lit(s))).alias(f"rate_{k}") for k, (m, s) in priors(hosts).items()]
    return hosts.select("host", "n", *shrunk)


def judged(docs: DataFrame) -> DataFrame:
    """The measures and failures of every document, ``base_failed``, ``host_rejected`` and ``kept``."""
    rows = written(measured(docs), "measures")
    suspect = [(F.col(f"rate_{r}") > SUSPECT).alias(f"suspect_{r}") for r in RULES]
    hosts = host_rates(rows).select(F.col("host").alias("verdict_host"), (F.col("rate_any") > REJECT).alias("host_rejected"), *suspect)
    both = rows.join(hosts, F.col("host").eqNullSafe(F.col("verdict_host")))
    base = reduce(or_, [F.col(r) for r in BASE])
    soft = reduce(or_, [F.col(r) & F.col(f"suspect_{r}") for r in RULES])
    return both.withColumn("base_failed", base).withColumn("kept", ~(base | F.col("host_rejected") | soft)) \
        .drop("verdict_host", *[f"suspect_{r}" for r in RULES])


def digest(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _digest_sql() -> str:
    rules = ", ".join(f"({rule}) AS {name}" for name, rule in RULES.items())
    kinds = [*RULES, "any_rule"]
    sums = ", ".join(f"count(*) FILTER (WHERE {k}) AS f_{k}" for k in kinds)
    moments = ", ".join(f"t_{k} / n_all AS m_{k}, v_{k}" for k in kinds)
    totals = ", ".join(f"sum(f_{k})::DOUBLE AS t_{k}" for k in kinds)
    squares = ", ".join(f"sum(n * (f_{k} / n - t_{k} / n_all) ** 2) AS v_{k}, any_value(t_{k}) AS t_{k}" for k in kinds)
    apart = {k: f"((v_{k} - m_{k} * (1 - m_{k}) * (n_hosts - 1)) / n_all)" for k in kinds}
    strengths = ", ".join(f"CASE WHEN {apart[k]} > 0 THEN greatest({LEAST_STRENGTH}, least({MOST_STRENGTH}, m_{k} * (1 - m_{k}) / {apart[k]} - 1))"
                          f" ELSE {MOST_STRENGTH} END AS s_{k}, m_{k}" for k in kinds)
    rates = ", ".join(f"(f_{k} + m_{k} * s_{k}) / (n + s_{k}) AS rate_{k}" for k in kinds)
    soft = " OR ".join(f"({r} AND rate_{r} > {SUSPECT})" for r in RULES)
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
    FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS t(k) GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN c ON c.rid = w.rid),
f AS (SELECT *, few_words OR repeats OR symbols OR same_lines OR word_length AS any_rule FROM (SELECT *, {rules} FROM m)),
h AS (SELECT source, count(*)::DOUBLE AS n, {sums} FROM f GROUP BY source),
t AS (SELECT sum(n) AS n_all, count(*) AS n_hosts, {totals} FROM h),
v AS (SELECT any_value(n_all) AS n_all, any_value(n_hosts) AS n_hosts, {squares} FROM h, t),
p AS (SELECT {strengths} FROM (SELECT n_all, n_hosts, {moments} FROM v)),
o AS (SELECT source, {rates} FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeats AS base_failed,
  NOT (few_words OR repeats OR rate_any_rule > {REJECT} OR {soft}) AS kept
FROM f JOIN o ON f.source IS NOT DISTINCT FROM o.source"""


DIGEST_SQL = _digest_sql()
