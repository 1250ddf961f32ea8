"""Line dedup over overlapping windows of three lines.  DataFrame functions only.

Every three consecutive lines are hashed.  A window that also occurs earlier, in the order
of document id and position, marks its lines; marked positions of a document are merged and
those lines removed.  The first occurrence of a window is marked by no copy of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import packed, unpacked, written

#: A character that is no white space; windows without any are blank.
TEXT = r"[^ \t\x0B\f\r]"


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Rows (id, text_hash, at, h1, h2): windows by 0-based place of their first line.

    Windows of blank lines only, of whatever white space, are left out.  128 bits of hash tell windows apart.
    """
    lines = F.split(F.col(text_col), "\n", -1)
    cut = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), lines.alias("lines")).where(F.size("lines") >= size)

    def window(k):
        parts = [F.get("lines", k + F.lit(j)) for j in range(size)]
        return F.when(F.concat(*parts).rlike(TEXT), F.struct(k.alias("at"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *reversed(parts)).alias("h2")))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.size("lines") - size), window), lambda w: w.isNotNull())
    return cut.select("id", "text_hash", F.inline(found))


def repeated_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Rows (id, text_hash, gone): sorted distinct places of lines to remove."""
    windows = line_windows(docs, id_col, text_col, size)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "at")
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    # As a scratch table, so that adaptive execution can split the join at a very common window.
    first = written(first.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first"), "repeated")
    later = (
        windows.join(first, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")))
        .where(place != F.col("first"))
        .select("id", "text_hash", "at")
        .groupBy("id", "text_hash")
        .agg(F.collect_set("at").alias("at"))
    )
    spread = F.flatten(F.transform("at", lambda a: F.sequence(a, a + size - 1)))
    return later.select("id", "text_hash", F.array_sort(F.array_distinct(spread)).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``docs`` with ``text_col`` rid of lines in later occurrences of repeated windows, and
    ``lines_removed`` (long) added.

    Every row stays; a text may become empty.  Null texts stay null, texts of fewer lines
    than a window stay as they are, and rows with the same id and text are one document.
    Rows with a null id come last in the order of occurrences.  Windows can overlap and
    repeat within one document.  Very long texts are cut into lines like others; an empty table
    gives none.
    """
    gone = repeated_positions(docs, id_col, text_col, size).select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "gone")
    rows = packed(docs, text_col, id=id_col).withColumn("hash", F.xxhash64("text"))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left")
    marked = joined.withColumn("marks", F.when(F.col("gone").isNotNull(), F.map_from_arrays("gone", "gone")))
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, k: F.try_element_at("marks", k).isNull()), "\n")
    changed = marked.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return unpacked(changed, docs, text_col, lines_removed=removed)
