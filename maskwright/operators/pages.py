"""The tabular side of editing paged documents: hits, styles and what is done with a file.

Reading and drawing pages needs a PDF library, which is an optional plug-in
(`sources.files.PdfEditor`); everything that decides what is drawn is here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_font, rgb, strip
from ..sources.scratch import written
from .replace import MOST, Keys

#: The style of text over which no span lies.
DEFAULT_FONT, DEFAULT_SIZE, DEFAULT_COLOR = "helv", 11.0, 0


def searchable(pages: DataFrame, mapping: DataFrame, document: str = "document", text: str = "text", most: int = MOST) -> DataFrame:
    """(document, searchable): whether any key that is not blank stands on any page. Keys go to the workers in parts of about `most`, each an automaton and a pass."""
    keys = mapping.where(strip(F.col("k")) != "").select("k").distinct()
    parts = max(1, -(-keys.count() // most))
    if parts > 1:
        keys = written(keys, "keys")
    plain = pages.select(F.col(document).alias("document"), F.col(text).alias("text"))
    kind = plain.schema["document"].dataType.simpleString()
    found = None
    for number in range(parts):
        shared = pages.sparkSession.sparkContext.broadcast([r.k for r in keys.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == number).collect()])

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = Keys((k, "") for k in shared.value)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch["document"], pa.array([bool(t) and held.any_in(t) for t in batch["text"].to_pylist()], pa.bool_())], names=["document", "hit"])

        hits = plain.mapInArrow(rows, f"document {kind}, hit boolean")
        found = hits if found is None else found.union(hits)
    return found.groupBy(F.col("document").alias(document)).agg(F.bool_or("hit").alias("searchable"))


def _cells(rectangles: DataFrame, name: str, grid: DataFrame, corner: bool = False) -> DataFrame:
    """The rectangles once for each cell of their page's grid that they touch, or for the cell of their first corner."""
    at = lambda axis, side: F.floor((F.col(f"{name}_{axis}{side}") - F.col(f"_{axis}0")) / F.col(f"_{axis}")).cast("long")
    met = rectangles.join(grid, "page")
    for axis in "xy":
        end = at(axis, 0) if corner else F.greatest(at(axis, 0), at(axis, 1))
        met = met.withColumn(f"_c{axis}", F.explode(F.sequence(at(axis, 0), end)))
    return met


def _grid(sides: list[tuple[DataFrame, str]], steps: int = 64) -> DataFrame:
    """(page, _x0, _y0, _x, _y): where each page's grid begins, and its steps: as wide as rectangles are on average, at most `steps` a page, so that rectangles touch few cells and cells hold few of them."""
    own = [df.select("page", *(F.col(f"{n}_{axis}{i}").cast("double").alias(f"{axis}{i}") for axis in "xy" for i in (0, 1))) for df, n in sides]
    step = lambda axis: F.greatest(F.avg(F.col(f"{axis}1") - F.col(f"{axis}0")), (F.max(f"{axis}1") - F.min(f"{axis}0")) / steps, F.lit(1e-9)).alias(f"_{axis}")
    return reduce(DataFrame.union, own).groupBy("page").agg(F.min("x0").alias("_x0"), F.min("y0").alias("_y0"), step("x"), step("y"))


def overlap_area(a: str, b: str) -> Column:
    """Of two rectangles given as columns <name>_x0, _y0, _x1, _y1."""
    side = lambda axis: F.greatest(F.least(F.col(f"{a}_{axis}1"), F.col(f"{b}_{axis}1")) - F.greatest(F.col(f"{a}_{axis}0"), F.col(f"{b}_{axis}0")), F.lit(0.0))
    return side("x") * side("y")


def best_styles(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """The hits (page, hit, hit_x0 ...) with the style of the span (page, ord, span_x0 ..., font, size, color) that overlaps most; the first of equal ones; a default where none does.

    Hits and spans meet in the cells of a grid over their page, so a crowded page makes
    no more pairs than lie near one another; a pair that shares several cells counts
    in the one where its overlap begins. One span a hit leaves the aggregation.
    """
    area = overlap_area("hit", "span")
    grid = _grid([(hits, "hit"), (spans, "span")])
    begins = lambda axis: F.floor((F.greatest(f"hit_{axis}0", f"span_{axis}0") - F.col(f"_{axis}0")) / F.col(f"_{axis}")) == F.col(f"_c{axis}")
    met = _cells(hits, "hit", grid).join(_cells(spans, "span", grid).drop("_x0", "_y0", "_x", "_y"), ["page", "_cx", "_cy"])
    best = (
        met.where(begins("x") & begins("y")).withColumn("area", area).where("area > 0")
        .groupBy("page", "hit").agg(F.max(F.struct("area", (-F.col("ord")).alias("first"), "font", "size", "color")).alias("s"))
    )
    joined = hits.join(best, ["page", "hit"], "left")
    font, color = F.coalesce("s.font", F.lit(DEFAULT_FONT)), F.coalesce("s.color", F.lit(DEFAULT_COLOR))
    return joined.withColumns({"font": font, "size": F.coalesce("s.size", F.lit(DEFAULT_SIZE)), "color": rgb(color), "base_font": base_font(font)}).drop("s")


def outer_hits(hits: DataFrame) -> DataFrame:
    """Hits that no other hit on the page contains, so a short key inside a long one is drawn once; of equal rectangles the longest key's stays, then the first hit. hits: (page, hit, k, hit_x0 ...).

    A hit looks for others in the cell of its first corner, which whatever contains it touches.
    """
    box = ["hit_x0", "hit_y0", "hit_x1", "hit_y1"]
    grid = _grid([(hits, "hit")])
    other = _cells(hits, "hit", grid).select(F.col("page").alias("_page"), F.col("_cx").alias("_ox"), F.col("_cy").alias("_oy"), F.col("hit").alias("_hit"), F.length("k").alias("_n"), *(F.col(c).alias(f"_{c}") for c in box))
    inside = (F.col("_hit_x0") <= F.col("hit_x0")) & (F.col("_hit_y0") <= F.col("hit_y0")) & (F.col("_hit_x1") >= F.col("hit_x1")) & (F.col("_hit_y1") >= F.col("hit_y1"))
    same = (F.col("_hit_x0") == F.col("hit_x0")) & (F.col("_hit_y0") == F.col("hit_y0")) & (F.col("_hit_x1") == F.col("hit_x1")) & (F.col("_hit_y1") == F.col("hit_y1"))
    first = (F.col("_n") > F.length("k")) | ((F.col("_n") == F.length("k")) & (F.col("_hit") < F.col("hit")))
    met = (F.col("page") == F.col("_page")) & (F.col("_cx") == F.col("_ox")) & (F.col("_cy") == F.col("_oy"))
    return _cells(hits, "hit", grid, corner=True).join(other, met & (F.col("_hit") != F.col("hit")) & inside & (~same | first), "left_anti").select(hits.columns)


def outcome(is_searchable: Column, recognised: Column, hits: Column) -> Column:
    """What becomes of a document: redacted, redacted_after_ocr or withheld. Where nothing was replaced the original is never passed on."""
    return F.when(is_searchable & (hits > 0), "redacted").when(~is_searchable & recognised & (hits > 0), "redacted_after_ocr").otherwise("withheld")


def editor_for(ext: Column) -> Column:
    return F.when(ext == ".pdf", "pdf").when(ext == ".docx", "docx").otherwise("none")
