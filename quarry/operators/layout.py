"""Page layout from extracted blocks: containment, captions and reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPTION = r"(?i)^\s*(图|figure|fig\.?)\s*[0-9]"


def drop_contained(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks that lie in no region of their page (borders count as inside)."""
    r = regions.select("page", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = (blocks["page"] == r["page"]) & (blocks["x0"] >= r["r_x0"]) & (blocks["y0"] >= r["r_y0"]) & (blocks["x1"] <= r["r_x1"]) & (blocks["y1"] <= r["r_y1"])
    return blocks.join(r, inside, "left_anti")


def nearest_caption(images: DataFrame, blocks: DataFrame, gap: float = 80.0, pattern: str = CAPTION) -> DataFrame:
    """Each image's caption: the text block of its page with the smallest vertical gap that overlaps it horizontally; of equally near ones the higher, then the one further left."""
    b = blocks.where(F.col("text").rlike(pattern)).select("page", "text", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    near = images.join(b, "page")
    distance = F.greatest(F.col("b_y0") - F.col("y1"), F.col("y0") - F.col("b_y1"), F.lit(0.0))
    near = near.withColumn("distance", distance).where((F.col("distance") <= gap) & (F.least("x1", "b_x1") - F.greatest("x0", "b_x0") > 0))
    best = near.groupBy("image_id").agg(F.min_by("text", F.struct("distance", "b_y0", "b_x0", "text")).alias("caption"))
    return images.join(best, "image_id", "left")


def assemble_pages(blocks: DataFrame) -> DataFrame:
    """blocks(page, kind, x0, y0, text, caption) -> one text per page in reading order under a page heading."""
    shown = F.when(F.col("kind") == "image", F.concat(F.lit("[image"), F.coalesce(F.concat(F.lit(": "), F.col("caption")), F.lit("")), F.lit("]"))).otherwise(F.col("text"))
    pages = blocks.withColumn("shown", shown).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "shown"))).alias("parts"))
    return pages.select("page", F.concat_ws("\n\n", F.concat(F.lit("# Page "), F.col("page").cast("string")), F.array_join(F.transform("parts", lambda p: p["shown"]), "\n\n")).alias("content"))
