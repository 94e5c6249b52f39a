"""Secret scans with multipart credential linking (operator 4). DataFrame and SQL functions only.

Parts of credentials are found as spans: assigned secrets, access identifiers and hexadecimal keys
(strong, always reported), bare 40-character secrets and endpoints (weak). A weak part says little
alone; it is reported only when a complementary part starts within ``SCOPE`` code points of its own
start: a bare secret with an access identifier or an endpoint, an endpoint with any secret or identifier.

The interval join runs inside each row: parts are ordered by start, and as parts of one kind do not
overlap and have a least length, those starting within the scope are among a bounded number of
neighbours. Nothing is shuffled, so no key can be hot, and a document's cost is linear in its text
and nearly so in its parts.

Spans are code point positions, end exclusive. Defined cases: null is the empty text; a text without
spans has zero counts, the hash of the empty text and an empty list; repeated rows give repeated
results; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 18
HEX = r"[0-9a-f]{16,}"  # runs are maximal, so the least length may stand in the pattern
# Weak parts of this method.
BARE = r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_.-])"
ENDPOINT = r"""(?i)(?:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+|(?<![a-z0-9.-])[a-z0-9-]{1,63}+(?:\.[a-z0-9-]{1,63}+){0,8}?\.amazonaws\.com"""
SCOPE = 400
_SHORTEST = 6  # code points of the shortest part, s3:// and one more
KINDS = ("assign", "access", "hex", "bare", "endpoint")
_CHUNK = 128  # pieces; even, so that a chunk begins between matches
_MARK, _OTHER = "\u0001", "\u0002"


def spans(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end, matched text).

    Matches are set between marks that occur in no pattern (a mark in the text is replaced by
    another sign first, which moves nothing), the text is split at the marks, and the lengths of the
    pieces before a match give its start. Pieces are taken in chunks, each walked from the length of those
    before it, as a list that grows by a piece is copied for each piece.
    """
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}")
    start = F.lit(0).cast("long")

    def total(chunk: Column) -> Column:
        return F.aggregate(chunk, start, lambda n, piece: n + F.length(piece))

    def begins(chunks: Column) -> Column:
        empty = F.struct(start.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(chunks, empty, lambda acc, chunk: F.struct(
            (acc["at"] + total(chunk)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def found_in(chunk: Column, begin: Column) -> Column:
        none = F.struct(begin.alias("at"), F.lit(False).alias("hit"), F.expr(_NONE).alias("out"))

        def step(acc: Column, piece: Column) -> Column:
            end = acc["at"] + F.length(piece)
            found = F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"), piece.alias("word"))
            return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"),
                            F.when(acc["hit"], F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(chunk, none, step, lambda acc: acc["out"])

    # a transform of a one-element array binds its value to a name, so that it is made once
    chunks = F.transform(F.array(F.split(marked, _MARK)), lambda pieces: F.transform(
        F.sequence(F.lit(1), F.size(pieces), F.lit(_CHUNK)), lambda i: F.slice(pieces, i, F.lit(_CHUNK))))[0]
    return F.transform(F.array(chunks), lambda c: F.flatten(F.zip_with(c, begins(c), found_in)))[0]


_NONE = "cast(array() as array<struct<start:bigint,kind:int,end:bigint,word:string>>)"


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id and ``parts``: the reported spans, ordered by start and kind."""
    none = F.expr(_NONE)
    text = F.col("text")
    found = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")) \
        .withColumn("assign", F.when(text.rlike(ASSIGN), F.filter(
            spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["word"], ASSIGN, 2)) >= ASSIGN_LEAST)).otherwise(none)) \
        .withColumn("access", F.when(text.contains("AKIA"), F.filter(
            spans(text, ACCESS, 1), lambda s: F.length(s["word"]) >= ACCESS_LEAST)).otherwise(none)) \
        .withColumn("hex", F.when(text.rlike(HEX), spans(text, HEX, 2)).otherwise(none)) \
        .withColumn("strong", F.concat("assign", "access", "hex"))
    linked = F.lower(text).rlike(r"://|\.amazonaws\.com")
    weak = found.withColumn("endpoint", F.when(linked, spans(text, ENDPOINT, 4)).otherwise(none)) \
        .withColumn("bare", F.when((F.size("access") > 0) | (F.size("endpoint") > 0), spans(text, BARE, 3)).otherwise(none)) \
        .select("doc_id", F.array_sort(F.concat("strong", "bare", "endpoint")).alias("all"))
    reach = len(KINDS) * (scope // _SHORTEST + 1)
    # kinds that complete a part: bare needs access or endpoint, endpoint needs any of the other four
    near = f"""filter(all, (p, i) -> p.kind < 3 OR exists(
        slice(all, greatest(i - {reach}, 0) + 1, {2 * reach} + 1),
        q -> abs(q.start - p.start) <= {scope}
             AND ((p.kind = 3 AND q.kind IN (1, 4)) OR (p.kind = 4 AND q.kind < 4))))"""
    return weak.select("doc_id", F.expr(near).alias("parts"))


def digest(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: counts per base kind, hash of the base spans, all spans."""
    found = scan(docs, scope)
    names = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), p.kind + 1)"
    listed = f"array_join(transform({{}}, p -> concat({names}, ':', p.start, ':', p.end)), ',')"
    count = "cast(size(filter(parts, p -> p.kind = {})) as bigint)"
    return found.select(
        "doc_id", *[F.expr(count.format(i)).alias(f"n_{KINDS[i]}") for i in range(3)],
        F.sha2(F.expr(listed.format("filter(parts, p -> p.kind < 3)")), 256).alias("base_sha256"),
        F.expr(listed.format("parts")).alias("spans"))
