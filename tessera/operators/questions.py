"""Question sheets: parsing, and counts by category.

A sheet has headers ``## <category>（<n> 道）`` and numbered items below them.  The declared number is not used; the
category's name is kept as it stands.  Where a category comes twice in a sheet, the later list stands at the first one's
place.  Null and empty sheets give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip

HEADER = r"## ([^（]+)（(\p{Nd}+) 道）"
ITEM = r"(?s)(\p{Nd}+)\.\s+(.+?)(?=\n\p{Nd}+\.|\n?\z)"


def categories(sheets: DataFrame, sheet: str = "text", key: str | None = None) -> DataFrame:
    """([key], cat_pos, category, body): the categories of each sheet, also those without questions.

    Without a key the rows are one sheet, whose categories are numbered in one task; many sheets need a key.
    """
    kept = [key] if key else []
    names = F.regexp_extract_all(F.col(sheet), F.lit(HEADER), F.lit(1))
    bodies = F.expr(f"slice(split(`{sheet}`, '{HEADER}'), 2, greatest(size(split(`{sheet}`, '{HEADER}')) - 1, 0))".replace("\\", "\\\\"))
    rows = sheets.where(F.col(sheet).isNotNull()).select(*kept, F.posexplode_outer(F.arrays_zip(names.alias("name"), bodies.alias("body"))).alias("at", "c")).where("at is not null")
    rows = rows.select(*kept, "at", F.col("c.name").alias("category"), F.col("c.body").alias("body"))
    same = Window.partitionBy(*kept, "category")
    latest = rows.withColumn("_last", F.max("at").over(same)).withColumn("_first", F.min("at").over(same)).where("at = _last")
    place = F.row_number().over(Window.partitionBy(*(kept or [F.lit(0)])).orderBy("_first")) - 1
    return latest.select(*kept, place.alias("cat_pos"), "category", "body")


def parse(sheets: DataFrame, sheet: str = "text", key: str | None = None) -> DataFrame:
    """([key], category, cat_pos, q_pos, id, text): the questions of each sheet."""
    kept = [key] if key else []
    items = F.arrays_zip(F.regexp_extract_all("body", F.lit(ITEM), F.lit(1)).alias("n"), F.regexp_extract_all("body", F.lit(ITEM), F.lit(2)).alias("t"))
    rows = categories(sheets, sheet, key).select(*kept, "category", "cat_pos", F.posexplode_outer(items).alias("q_pos", "i")).where("q_pos is not null")
    return rows.select(*kept, "category", "cat_pos", "q_pos", F.col("i.n").cast("bigint").alias("id"), strip(F.col("i.t")).alias("text"))


def summary(listed: DataFrame, questions: DataFrame) -> DataFrame:
    """(category, n_questions): questions of every category, 0 included; ``listed`` has one row a category."""
    names = listed.select("category").distinct()
    counts = questions.groupBy("category").agg(F.count("id").alias("n"))
    return names.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n_questions"))


def summary_text(counts: DataFrame) -> DataFrame:
    """(summary): total, number of categories, and a line for each in code point order."""
    lines = F.array_sort(F.collect_list(F.struct("category", "n_questions")))
    one = counts.agg(F.coalesce(F.sum("n_questions"), F.lit(0)).alias("total"), F.count("*").alias("n"), lines.alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("  "), x["category"], F.lit(": "), x["n_questions"].cast("string"))), "\n")
    return one.select(F.concat(F.lit("questions: "), F.col("total").cast("string"), F.lit("\ncategories: "), F.col("n").cast("string"), F.lit("\n"), body).alias("summary"))


def sheet(questions: DataFrame, key: str | None = None) -> DataFrame:
    """([key], text): the sheet from which ``parse`` gives these questions back."""
    kept = [key] if key else []
    item = F.concat(F.col("id").cast("string"), F.lit(". "), F.col("text"))
    lists = questions.groupBy(*kept, "category", "cat_pos").agg(F.array_sort(F.collect_list(F.struct("q_pos", item.alias("item")))).alias("items"))
    head = F.concat(F.lit("## "), F.col("category"), F.lit("（"), F.size("items").cast("string"), F.lit(" 道）\n"))
    part = F.concat(head, F.array_join(F.transform("items", lambda x: x["item"]), "\n"), F.lit("\n"))
    parts = lists.select(*kept, "cat_pos", part.alias("part"))
    rows = parts.groupBy(*kept).agg(F.array_sort(F.collect_list(F.struct("cat_pos", "part"))).alias("parts"))
    return rows.select(*kept, F.array_join(F.transform("parts", lambda x: x["part"]), "\n").alias("text"))
