"""Main-text extraction with site style trees (operator 8).

The pages of a host are merged: elements with the same path of styles (tags and classes) are one node
of its tree. A node's importance has two parts. Presentation: the entropy of the child styles it has
over its pages (many layouts are important, one is not). Content: one less the mean entropy of its
text blocks over its pages (a block that stands on all pages is worth nothing, one that stands on a
single page everything). It is held against a prior of ``PRIOR`` pages of full importance, so that few pages say
little. A branch whose importance is then below ``LEAST`` is removed from every page.

Elements that say what they are keep that importance: none for navigation, headers, footers, asides,
forms and elements marked as adverts, notices, comments and the like; full for an article and for its
paragraphs and headings, as a paragraph may well be shared by many pages, and no branch in an article goes by
repetition. Where a page has an article or main element, its text is what is read. Copies of a page on a host
count as one page.

The tree is counted, not gathered: pages give (node, block) rows, counts are aggregated before and after
the shuffle, and only the nodes to remove come back, one row per host. A host with a third of all pages
is more rows in those counts, and its pages stay where they are or are split.

Defined cases: null and empty html give empty text; a page without a host (null or odd address) belongs
to the host without a name; pages with the same id are pages of their own; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import markup
from tidemark.llm.common import ship, written

LEAST = 0.2
PRIOR = 0.5  # pages of full importance that every node is taken to have had before: a branch of few pages is doubted less
GAMMA = 0.9  # weight of content against presentation
# Elements the tree may remove; text elements themselves are never removed by repetition.
BRANCHES = {"div", "section", "ul", "ol", "dl", "table", "figure", "details", "center", "nav", "footer", "aside", "header", "form"}


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _contents(batches):
    """host, html and a hash of the page's text blocks with their places."""
    for batch in batches:
        texts = batch.column("html").to_pylist()
        found = [markup.key("\n".join(f"{e.node} {b}" for e, b in markup.read(t)[1])) if t else 0 for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.int64()), batch.column("html")], ["host", "content", "html"])


def distinct_contents(pages: DataFrame) -> DataFrame:
    """host, html of ``pages``, one row of the copies of a page on a host."""
    ship(pages.sparkSession)
    rows = pages.select("host", "html").mapInArrow(_contents, "host string, content long, html string")
    return rows.dropDuplicates(["host", "content"]).select("host", "html")


def _features(batches):
    """(host, node, kind, feature) once per page: kind 0 for presentation, 1 for content."""
    for batch in batches:
        rows = []
        for site, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if not text:
                continue
            found = set()
            for e in markup.read(text, branches=True)[0]:
                if e.tag in BRANCHES:
                    node, last = e.node, None
                    shape = [last := c for c in e.children if c != last]  # runs of one style count as one
                    found.add((node, 0, markup.key("/".join(shape))))
                    found.update((node, 1, markup.key(b)) for b in set(e.blocks))
            rows += [(site, *f) for f in found]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())],
            ["host", "node", "kind", "feature"])


def importance(pages: DataFrame) -> DataFrame:
    """host, node, pages, importance, held: the style trees of all hosts of ``pages`` (host, html).

    ``held`` is the importance with the prior: it is nearer to one the fewer pages a node was seen on.
    """
    ship(pages.sparkSession)
    seen = distinct_contents(pages).mapInArrow(_features, "host string, node long, kind int, feature long")
    counted = seen.groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    nodes = counted.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        F.sum(F.when(F.col("kind") == 0, n * F.log(n))).alias("layouts"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("blocks"),
        F.sum(F.when(F.col("kind") == 1, n * F.log(n))).alias("repeated"))
    size = F.log(F.col("pages").cast("double"))
    presentation = F.when(F.col("pages") > 1, (size - F.col("layouts") / F.col("pages")) / size).otherwise(1.0)
    content = F.when((F.col("pages") > 1) & (F.col("blocks") > 0), 1 - F.col("repeated") / (F.col("blocks") * size)).otherwise(1.0)
    own = (1 - GAMMA) * presentation + GAMMA * content
    return nodes.select("host", "node", "pages", own.alias("importance"), ((own * F.col("pages") + PRIOR) / (F.col("pages") + PRIOR)).alias("held"))


def main_text(text: str, removed: set[int]) -> str:
    """The blocks of a page that stand in no removed branch, one to a line."""
    elements, blocks = markup.read(text)
    around, up = set(), next((e for e in elements if markup.is_article(e)), None)
    while up is not None:
        around.add(id(up))
        up = up.parent
    gone: set[int] = set()
    for e in elements:  # each after the one it stands in
        if id(e.parent) in gone or e.tag in BRANCHES and e.node in removed and id(e) not in around and not e.in_article \
                or markup.is_furniture(e, id(e) in around):
            gone.add(id(e))
    live = [(e, b) for e, b in blocks if id(e) not in gone]
    if any(markup.is_article(e) and id(e) not in gone for e in elements):
        live = [(e, b) for e, b in live if e.in_article]
    return "\n".join(b for _, b in live)


def _extract(batches):
    for batch in batches:
        texts = [main_text(h, set(cut or ())) if h else "" for h, cut in zip(batch.column("html").to_pylist(), batch.column("removed").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    trees = importance(rows).where(F.col("held") < least)
    removed = written(trees.groupBy("host").agg(F.collect_list("node").alias("removed")), "style-trees")
    return rows.join(removed, "host", "left").select("page_id", "url", "html", "removed") \
        .mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
