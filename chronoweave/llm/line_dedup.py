"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate of a site if the pages of that site that contain it, divided by all its pages,
exceed ``ratio``, and at least ``min_pages`` pages contain it. Lines are compared trimmed, as 64-bit
fingerprints; every occurrence of a boilerplate line is dropped. ``drop_boilerplate_lines`` counts equal
texts of a site as one page, so that copies of a document do not make its own lines boilerplate before
near-duplicate removal has chosen one of them; ``line_report`` counts every row, as its SQL does.

Scale: the only exploded data are (site, fingerprint) pairs, which Spark counts before the shuffle, so a
site with a third of all pages costs no more than its distinct lines. The boilerplate lists come back as
one array per site: at most (lines per page / ratio) entries. They are broadcast if all of them together
have at most ``MAX_BROADCAST_LINES`` entries, and joined by site otherwise (AQE splits the hot site).

Defined cases: null text stays null with 0 lines; an empty text is one empty line; empty lines are never
boilerplate; a null site is a site of its own; repeated rows are separate pages in ``line_report`` and one in ``drop_boilerplate_lines``; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import stored

MAX_BROADCAST_LINES = 200_000


def _fingerprint(line):
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, ratio: float, min_pages: int, text: str = "text", site: str = "source", copies_once: bool = False) -> DataFrame:
    """(site, lines): fingerprints of each site's boilerplate lines; with copies_once, equal texts of a site are one page."""
    lines = F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != ""), _fingerprint))
    docs = docs.select(F.col(site).alias("_site"), F.md5(text).alias("_text"), lines.alias("_lines"))
    if copies_once:
        docs = docs.groupBy("_site", "_text").agg(F.first("_lines").alias("_lines"))
    pages = docs.groupBy("_site").agg(F.count("*").alias("_pages"))
    counts = docs.select("_site", F.explode("_lines").alias("_line")).groupBy("_site", "_line").agg(F.count("*").alias("_n"))
    hot = counts.where(F.col("_n") >= min_pages).join(pages, counts["_site"].eqNullSafe(pages["_site"])).where(F.col("_n") > ratio * F.col("_pages"))
    return hot.groupBy(counts["_site"].alias("_site")).agg(F.sort_array(F.collect_set("_line")).alias("_lines"))


def with_kept_lines(docs: DataFrame, ratio: float = 0.02, min_pages: int = 5, text: str = "text", site: str = "source", copies_once: bool = False) -> DataFrame:
    """``docs`` with _all (its lines) and _kept (those that are not boilerplate); null for null text."""
    found = stored(boilerplate(docs, ratio, min_pages, text, site, copies_once)).withColumnRenamed("_site", "_boiler_site")
    size = found.agg(F.sum(F.size("_lines"))).first()[0] or 0
    found = F.broadcast(found) if size <= MAX_BROADCAST_LINES else found
    joined = docs.join(found, docs[site].eqNullSafe(found["_boiler_site"]), "left")
    kept = F.filter(F.col("_all"), lambda x: ~F.coalesce(F.array_contains("_lines", _fingerprint(x)), F.lit(False)) | (F.trim(x) == ""))
    return joined.withColumn("_all", F.split(text, "\n", -1)).withColumn("_kept", kept).drop("_lines", "_boiler_site")


def drop_boilerplate_lines(docs: DataFrame, ratio: float = 0.02, min_pages: int = 5, text: str = "text", site: str = "source") -> DataFrame:
    """``docs``, same columns, without the boilerplate lines; n_chars follows the text where it exists."""
    out = with_kept_lines(docs, ratio, min_pages, text, site, copies_once=True).withColumn(text, F.array_join("_kept", "\n"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_kept") < F.size("_all"), F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def line_report(docs: DataFrame, ratio: float = 0.02, min_pages: int = 5) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, and the digest of the remaining text (null: empty)."""
    rows = with_kept_lines(docs.select("doc_id", "text", "source"), ratio, min_pages)
    n = F.coalesce(F.size("_all"), F.lit(0))
    n = F.when(F.col("_all").isNull(), 0).otherwise(n).cast("long")
    kept = F.when(F.col("_kept").isNull(), 0).otherwise(F.size("_kept")).cast("long")
    return rows.select("doc_id", n.alias("n_lines"), (n - kept).alias("n_removed"), F.sha2(F.coalesce(F.array_join("_kept", "\n"), F.lit("")), 256).alias("kept_sha256"))
