"""Licence scans with ordered signature rules (operator 3). DataFrame and SQL functions only.

A keyword prefilter passes the texts that can hold any signature. Their words are numbered; at every
word that some rule starts with, the rules of that word whose second keyword is near are matched
against the next words; all that match take part. Of overlapping detections the longer one wins (so one
inside another goes), then the one of higher priority, then the first; one that lost removes no other. Everything
happens inside the row: nothing is shuffled, and the cost is linear in the words, but for runs of detections that
overlap in a chain, whose winners are looked through for each detection of the run.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. Defined cases: null is
the empty text; a text without detections has null first and last word, empty labels and score 0;
repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import matches
from tidemark.llm.signatures import LONGEST, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The ASCII signs between words, one by one: Java looks single signs up in a table, but tests ranges in turn.
_BETWEEN = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
WORD = f"[^{_BETWEEN}]++"
GAP = f"[{_BETWEEN}]++"
# Fixed phrases and labels; they are always reported.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Every signature holds one of these, whatever stands between its words ...
KEYWORDS = ("licen", "creative", "clause", "spdx", "domain", "reserved", "hereby", "permission", "redistribut", "unencumbered",
            "provided", "confidential", "released", "distributed", "available")
# ... or one of these as a word.
ABBREVIATIONS = ("gpl", "gfdl", "mpl", "epl", "cddl", "eupl", "odbl", "cecill", "wtfpl", "bsd", "cc")
ABBREVIATED = r"(?i)(?<![a-z0-9])(?:[al]?gpl|gfdl|mpl|epl|cddl|eupl|odbl|cecill|wtfpl|bsd|cc0?)(?![a-z0-9])"
_RULE = "map<string,array<struct<need:string,pattern:string,label:string,rank:int>>>"


def _any(words) -> Column:
    return reduce(or_, (F.col("lower").contains(w) for w in words))


def detections(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, ``base`` and ``found``: arrays of (start, end, label) over word numbers."""
    by_lead: dict[str, list[dict]] = {}
    for r in rules():
        by_lead.setdefault(r["lead"], []).append({k: r[k] for k in ("need", "pattern", "label", "rank")})
    leads = sorted({*by_lead, *(p.split(" ")[0] for p in BASE)})
    text = F.col("text")
    gated = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")) \
        .withColumn("lower", F.lower(text)).withColumn("gate", _any(KEYWORDS) | (_any(ABBREVIATIONS) & text.rlike(ABBREVIATED))) \
        .drop("lower").withColumn("n_words", matches(text, WORD))
    words = gated.withColumn("words", F.when(F.col("gate"), F.split(F.trim(F.regexp_replace(F.translate("text", UPPER, LOWER), GAP, " ")), " ", -1))) \
        .drop("text")
    lead_list = ", ".join(f"'{w}'" for w in leads)
    places = words.withColumn("hits", F.expr(f"""
        filter(transform(words, (w, i) -> if(w IN ({lead_list}), struct(i AS at, w AS lead,
            array_join(slice(words, i + 1, {LONGEST}), ' ') AS near), null)), h -> h IS NOT NULL)""")).drop("words")
    ruled = places.withColumn("rules", F.from_json(F.lit(json.dumps(by_lead)), _RULE))
    best = """
        filter(transform(hits, h -> struct(h.at AS start,
            transform(filter(transform(
                filter(element_at(rules, h.lead), r -> instr(h.near, r.need) > 0),
                r -> named_struct('hit', regexp_extract(h.near, r.pattern, 1), 'rank', r.rank, 'label', r.label)), m -> m.hit <> ''),
                m -> struct(length(m.hit) - length(replace(m.hit, ' ', '')) + 1 AS size, m.rank AS rank, m.label AS label)) AS rivals)),
            d -> size(d.rivals) > 0)"""
    # a place reaches as far as its longest rival; places that reach into each other are a run
    spans = "transform(picked, d -> struct(d.start AS start, d.start + array_max(d.rivals).size AS end, d.rivals AS rivals))"
    rivals = "flatten(transform(run, p -> transform(p.rivals, c -> struct(p.start AS start, p.start + c.size AS end, c.label AS label, c.rank AS rank))))"
    base = ", ".join(f"struct('{p}' AS phrase, '{label}' AS label, {p.count(' ') + 1} AS size)" for p, label in BASE.items())
    return ruled.withColumn("base", F.expr(f"""
            flatten(transform(hits, h -> transform(filter(array({base}), b -> startswith(concat(h.near, ' '), concat(b.phrase, ' '))),
                b -> struct(h.at AS start, h.at + b.size AS end, b.label AS label))))""")) \
        .withColumn("picked", F.expr(best)).withColumn("picked", F.expr(spans)) \
        .withColumn("firsts", F.expr(f"""
            filter(transform(picked, (d, i) -> if(exists(slice(picked, greatest(i - {LONGEST}, 0) + 1, least(i, {LONGEST})), e -> d.start < e.end), null, i)),
                i -> i IS NOT NULL)""")) \
        .withColumn("runs", F.expr("transform(firsts, (i, k) -> slice(picked, i + 1, coalesce(get(firsts, k + 1), size(picked)) - i))")) \
        .withColumn("found", F.expr(f"""
            flatten(transform(transform(runs, run -> {rivals}), run -> transform(if(size(run) = 1, run, array_sort(aggregate(
                array_sort(run, (d, e) -> if(struct(d.end - d.start, d.rank, -d.start) > struct(e.end - e.start, e.rank, -e.start), -1, 1)),
                cast(array() as array<struct<start:int,end:int,label:string,rank:int>>),
                (won, d) -> if(exists(won, e -> e.start < d.end AND d.start < e.end), won, concat(won, array(d)))))),
                d -> struct(d.start AS start, d.end AS end, d.label AS label))))""")) \
        .select("doc_id", "n_words", "base", "found")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: base places, labels of both kinds, and the share of words in detections."""
    none = "coalesce({}, cast(array() as array<struct<start:int,end:int,label:string>>))"
    full = detections(docs).withColumn("base", F.expr(none.format("base"))).withColumn("found", F.expr(none.format("found")))
    covered = "aggregate(found, 0L, (n, d) -> n + d.end - d.start)"
    return full.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.expr("cast(array_min(transform(base, b -> b.start)) as bigint)").alias("first_word"),
        F.expr("cast(array_max(transform(base, b -> b.start)) as bigint)").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(transform(base, b -> b.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(transform(base, b -> b.label), transform(found, d -> d.label)))), ',')").alias("labels"),
        F.expr(f"if(n_words = 0, 0D, least(1D, {covered} / n_words))").alias("score"))
