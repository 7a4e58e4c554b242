"""HTML extraction with a site style tree.

Pages of one host are merged into one tree of element paths. A path's
presentation importance is the entropy of the child sequences it has on the
host's pages; its content importance is one minus the mean normalized
entropy of its texts, a text that stands on n of the m pages having entropy
log(n) / log(m). Paths of low importance are template and leave every page
of the host; those in article and main elements have ``PRIOR`` more, so it
takes texts that nearly all pages share. Element names and class words that
declare themselves page furniture (menus, adverts, comments, ...) have no
importance on any host. What is left in article and main elements is the
text of a page, unless more than ``TEASER`` times as much is left outside:
then they are teasers beside the text, and the text is all that is left.

Copies of one page count once for the entropies. Hosts with fewer than
``MIN_PAGES`` different pages have too little evidence and only lose what
declares itself furniture.

Edge cases: null or empty html gives an empty text; a null or host-less URL
puts the page on the empty host; repeated rows are extracted one by one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrate.llm.common import written
from shelfrate.llm.dom import HEADINGS, Block, read
from shelfrate.llm.url_filter import url_host

MIN_PAGES = 5
MIN_IMPORTANCE = 0.35
PRESENTATION_SHARE = 0.1
PRIOR, TEASER = 0.2, 2

# Elements and class words of page furniture, and of content.
FURNITURE_TAGS = frozenset("nav footer aside form select menu dialog head option legend fieldset search".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification pagination pager popup promo promoted promotion recommended related replies search "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets "
    "contentinfo complementary".split())
CONTENT_TAGS = frozenset(("article", "main"))
# Class words that make furniture even of an article element.
NO_ARTICLE_WORDS = frozenset("ad ads advert comment comments promo recommended related replies sponsored".split())


def is_furniture(block: Block) -> bool:
    """True if an element around the block declares itself page furniture.

    The heading of an article may stand in a header of its own.
    """
    heading = block.frames and block.frames[-1].tag in HEADINGS
    inside = False
    for f in block.frames:
        if f.tag in FURNITURE_TAGS:
            return True
        words = f.names & (NO_ARTICLE_WORDS if f.tag in CONTENT_TAGS else FURNITURE_WORDS)
        if f.tag in ("html", "body"):  # "has-sidebar" and the like describe the page
            words = frozenset()
        if f.tag == "header" or words == {"header"}:
            if not (inside and heading):
                return True
        elif words:
            return True
        inside = inside or f.tag in CONTENT_TAGS
    return False


def in_content(block: Block) -> bool:
    """True if the block lies in an article or main element."""
    return any(f.tag in CONTENT_TAGS for f in block.frames)


def path_in_content(path: str) -> bool:
    """True if the path passes an article or main element."""
    return any(part.split(".", 1)[0] in CONTENT_TAGS for part in path.split("/"))


def _key(path: str) -> int:
    return int.from_bytes(hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big",
                          signed=True)


def _observations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, content, style, feature, page): each page's distinct child sequences and texts by path."""
    for b in batches:
        rows = set()
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            blocks, styles = read(page)
            mark = _key(page or "")
            for path, children in styles:
                rows.add((host, _key(path), path_in_content(path), True, _key(children), mark))
            for block in blocks:
                if not is_furniture(block):
                    rows.add((host, _key(block.path), in_content(block), False, _key(block.text), mark))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                         names=["host", "path", "content", "style", "feature", "page"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, importance, n_pages) of every element path of every host; ``pages`` is (host, html)."""
    seen = pages.select("host", "html").mapInArrow(
        _observations, "host string, path long, content boolean, style boolean, feature long, page long").distinct()
    counted = seen.groupBy("host", "path", "content", "style", "feature").agg(F.count(F.lit(1)).alias("n"))
    # The sum of n over a path's child sequences is its number of pages m.
    summed = counted.groupBy("host", "path", "content").agg(
        F.sum(F.when(F.col("style"), F.col("n")).otherwise(0)).alias("m"),
        F.sum(F.when(F.col("style"), F.col("n") * F.log("n")).otherwise(0.0)).alias("style_nlogn"),
        F.sum(F.when(~F.col("style"), F.log("n")).otherwise(0.0)).alias("text_log"),
        F.sum(F.when(~F.col("style"), 1).otherwise(0)).alias("texts"))
    log_m = F.log(F.greatest("m", F.lit(2)))
    presentation = (log_m - F.col("style_nlogn") / F.greatest("m", F.lit(1))) / log_m
    content = 1 - F.col("text_log") / F.greatest("texts", F.lit(1)) / log_m
    return summed.select("host", "path", F.col("m").alias("n_pages"), F.when(F.col("m") < MIN_PAGES, 1.0).otherwise(
        PRESENTATION_SHARE * presentation + (1 - PRESENTATION_SHARE) * content
        + F.when(F.col("content"), PRIOR).otherwise(0.0)).alias("importance"))


def main_text(page: str | None, low: frozenset) -> str:
    """The text of a page without furniture and without the paths in ``low``."""
    blocks = [b for b in read(page)[0] if not is_furniture(b) and _key(b.path) not in low]
    inside = [b for b in blocks if in_content(b)]
    n_inside, n_all = (sum(len(b.text) for b in part) for part in (inside, blocks))
    return " ".join(b.text for b in (blocks if n_all - n_inside > TEASER * n_inside else inside))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(page, frozenset(low or ())) for page, low in
                 zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["_id", "_url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every row of ``pages``."""
    src = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"),
                       url_host(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html"))
    low = (written(style_tree(src).where(F.col("importance") < MIN_IMPORTANCE), "style-tree")
           .groupBy("host").agg(F.collect_list("path").alias("low")))
    joined = src.join(low, "host", "left").select("_id", "_url", "html", "low")
    schema = f"_id {dict(src.dtypes)['_id']}, _url string, text string, n_chars long"
    return joined.mapInArrow(_extract, schema).select(F.col("_id").alias(id_col), F.col("_url").alias(url_col),
                                                      "text", "n_chars")
