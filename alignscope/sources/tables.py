"""Text tables and documents: CSV with a schema or with types read off, JSON, info files, and a unified dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_category_counts
from ..model import CATEGORIES, CODES

#: Columns of an index that aren't categories.
INDEX = ("image", "split", "ih", "iw", "sh", "sw")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", escape='"', multiLine=False)


def read_csv_typed(spark: SparkSession, path: str) -> DataFrame:
    """Column types read off the values: whole numbers, decimals, else text. Costs a second scan; prefer a schema."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", escape='"')
    tests = [f(F.coalesce(F.col(f"`{c}`"), F.lit("0")).rlike(p)).alias(f"{k}{i}") for i, c in enumerate(raw.columns) for k, p, f in (("i", r"^\d+$", F.bool_and), ("f", r"^\d+(\.\d*)?$", F.bool_and))]
    seen = raw.agg(*tests).first()
    kind = lambda i: "long" if seen[f"i{i}"] else "double" if seen[f"f{i}"] else "string"
    return raw.select(*[F.col(f"`{c}`").cast(kind(i)).alias(c) for i, c in enumerate(raw.columns)])


def write_csv(df: DataFrame, path: str, small: bool = True) -> None:
    """One file where the table is small (vocabularies, results), else as many as there are partitions."""
    (df.coalesce(1) if small else df).write.mode("overwrite").csv(path, header=True, escape='"', encoding="UTF-8")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=True)


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """``key: value`` lines: key, value as text. Values are never evaluated."""
    lines = spark.read.text(path)
    return lines.where(F.col("value").contains(":")).select(F.trim(F.substring_index("value", ":", 1)).alias("key"), F.trim(F.regexp_replace("value", r"^[^:]*:", "")).alias("value"))


def read_unified(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """index, category and label tables of a unified dataset folder.

    The index is long: image, split, ih, iw, sh, sw, category, ord, label int or file string, exactly one of them set.
    """
    raw = spark.read.csv(f"{folder}/index.csv", header=True, encoding="UTF-8")
    categories = [c for c in raw.columns if c not in INDEX]
    sizes = [F.col(c).cast("int").alias(c) if c in INDEX[2:] else F.col(c) for c in INDEX]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.split(F.coalesce(F.col(f"`{c}`"), F.lit("")), ";").alias("cells")) for c in categories])).alias("c")
    long = raw.select(*sizes, cells).select(*INDEX, "c.category", F.posexplode("c.cells").alias("ord", "cell")).where("cell <> ''")
    whole = F.col("cell").rlike(r"^\d+$")
    index = long.select(*INDEX, "category", "ord", F.when(whole, F.col("cell").cast("int")).alias("label"), F.when(~whole, F.col("cell")).alias("file"))
    label = read_csv(spark, f"{folder}/label.csv", "number int, name string, category string, frequency long, coverage double, syns string")
    label = label.withColumn("categories", parse_category_counts(F.col("category")))
    return {"index": index, "category": read_csv(spark, f"{folder}/category.csv", CATEGORIES), "label": label}


def read_codes(spark: SparkSession, folder: str, category: str) -> DataFrame:
    return read_csv(spark, f"{folder}/c_{category}.csv", CODES)


def wide_index(index: DataFrame, categories: list[str]) -> DataFrame:
    """The long index as it is stored: one column per category, its cells joined by semicolons, dominant first."""
    cell = F.coalesce(F.col("label").cast("string"), F.col("file"))
    cells = index.groupBy(*INDEX).pivot("category", categories).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", cell.alias("cell")))), lambda s: s["cell"]), ";"))
    return cells


def write_unified(index: DataFrame, category: DataFrame, label: DataFrame, codes: DataFrame, folder: str) -> None:
    """The folder that ``read_unified`` reads. codes: category, code, number, name, frequency, coverage."""
    names = [r["name"] for r in category.orderBy("first").select("name").collect()]
    write_csv(wide_index(index, names), f"{folder}/index.csv", small=False)  # a row an image
    write_csv(category.orderBy("first"), f"{folder}/category.csv")
    write_csv(label.orderBy("number"), f"{folder}/label.csv")
    for name in names:
        write_csv(codes.where(F.col("category") == name).drop("category").orderBy("code"), f"{folder}/c_{name}.csv")


def has_any(index: DataFrame, categories: list[str]) -> DataFrame:
    """Images with a label in at least one of the categories."""
    return index.where(F.col("category").isin(categories)).select("image").distinct()


def has_all(index: DataFrame, categories: list[str]) -> DataFrame:
    """Images with a label in every one of the categories."""
    counts = index.where(F.col("category").isin(categories)).groupBy("image").agg(F.countDistinct("category").alias("n"))
    return counts.where(F.col("n") == len(set(categories))).select("image")
