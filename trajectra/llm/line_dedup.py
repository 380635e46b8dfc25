"""Line dedup by site-relative frequency, in DataFrame operations only.

Documents are grouped by host. A line's ratio is the number of the host's documents that hold it
over the host's documents; lines above ``max_ratio`` are boilerplate of that host and are dropped
from its documents. Nothing else decides, but that a line must be on ``min_pages`` documents (or
all, of a host with two), as a ratio of fewer says nothing.

Copies are kept apart before counting, as lines of a copied document aren't boilerplate: documents
with the same own lines count once. Own are the lines that aren't over ``max_ratio`` when all
documents count. So menus, notices and footers on every page count by page, however many there
are, while copies, whose lines are all frequent or all equal, count as one document. The host's
documents are counted with all copies.

Counting works on 64-bit hashes of the trimmed lines, distinct per document, and is reduced before
each shuffle, so a line on every page is no hot key. A host has at most (mean lines a document) /
max_ratio frequent lines. While their counted number allows, they are sent to the documents, a row
with all lines per host, and texts aren't shuffled; beyond, documents meet them by host and salt.

Cases: blank lines are never dropped; a null text stays null with no lines; a null host is a host
of its own, and that of the empty name; repeated rows are copies; an empty table gives no rows;
columns of any name pass through, and own ones named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import give_back, protect
from .store import discard, materialize

#: Up to so many lines of all hosts (8 bytes each) are broadcast, after they have been counted.
BROADCAST_LINES = 500_000
#: Beyond, a host's documents are spread over so many joins' keys.
SALTS = 32
#: On the check tables lines that stand among own content are on 0.2 to 13 percent of a host's documents, and lines of copies, those of equal content counted once, on less than 0.5.
MAX_RATIO, MIN_PAGES = 0.005, 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(text: Column) -> Column:
    """Hashes of the lines that aren't blank, once each."""
    return F.array_distinct(F.transform(F.filter(F.transform(_lines(text), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x)))


def _host(host: str) -> Column:
    return F.coalesce(F.col(f"`{host}`").cast("string"), F.lit(""))


def _by_host(rows: DataFrame, lines: DataFrame, name: str) -> DataFrame:
    """Rows with the stored lines of their host (``__host``) as an array."""
    n = lines.count()
    found = lines.groupBy(F.col("host").alias("__host")).agg(F.collect_set("line").alias(name))
    if n <= BROADCAST_LINES:
        return rows.join(F.broadcast(found), "__host", "left")
    found = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(found.hint("merge"), ["__host", "__salt"], "left").drop("__salt")


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, n_pages, host_pages), stored: the hashes of the lines to drop, and the documents of different content that hold them."""
    rows = docs.select(_host(host).alias("__host"), _hashes(F.col(f"`{text}`").cast("string")).alias("held"))
    totals = rows.groupBy(F.col("__host").alias("host")).agg(F.count("*").alias("host_pages"))
    enough = (F.col("n_pages") > F.col("host_pages") * F.lit(max_ratio)) & (F.col("n_pages") >= F.greatest(F.lit(2), F.least(F.lit(min_pages), F.col("host_pages"))))
    counts = rows.select(F.col("__host").alias("host"), F.explode("held").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n_pages"))
    frequent = materialize(counts.join(totals, "host").where(enough), "frequent-lines")
    known = _by_host(rows.where("size(held) > 0"), frequent, "frequent").where("frequent IS NOT NULL")
    own = known.select("__host", F.explode(F.array_intersect("held", "frequent")).alias("line"), F.xxhash64(F.array_sort(F.array_except("held", "frequent"))).alias("own"))
    contents = own.groupBy("__host", "line", "own").agg(F.lit(1).alias("one")).groupBy(F.col("__host").alias("host"), "line").agg(F.count("*").alias("n_pages"))
    found = materialize(contents.join(frequent.select("host", "line", "host_pages"), ["host", "line"]).where(enough), "boilerplate")
    discard(frequent)
    return found


def dedup_lines(docs: DataFrame, text: str = "text", host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines dropped from ``text``, and ``n_lines`` and ``n_dropped`` added."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own, names = protect(docs.select(*[F.col(f"`{c}`") for c in columns]), (text, host))
    flagged = boilerplate(own, text, host, max_ratio, min_pages).select("host", "line")
    joined = _by_host(own.withColumn("__host", _host(host)), flagged, "__drop")
    lines = _lines(F.col(text).cast("string"))
    kept = F.when(F.col("__drop").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__drop"), F.xxhash64(F.trim(x)))))
    joined = joined.withColumn("__kept", kept)
    has_text = F.col(text).isNotNull()
    out = joined.select(
        *[F.when(has_text, F.array_join("__kept", "\n")).alias(c) if c == text else F.col(f"`{c}`") for c in own.columns],
        F.when(has_text, F.size(lines)).otherwise(0).cast("long").alias("n_lines"),
        F.when(has_text, F.size(lines) - F.size("__kept")).otherwise(0).cast("long").alias("n_dropped"),
    )
    return give_back(out, names, [*columns, "n_lines", "n_dropped"])
