"""Label vocabularies: statistics, numbering, remapping and splits of a unified dataset."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import numbered, sent


def label_statistics(pixels: DataFrame, sizes: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """Images with a label, and their pixel shares summed: dataset, category, label, frequency, coverage.

    pixels: image, dataset, category, label, and pixels (of the image) where they are known on the way, so that no join is
    needed; else sizes: image, pixels. images: image, dataset, category, label for labels of whole images, which cover
    all of them.
    """
    known = pixels if "pixels" in pixels.columns else pixels.join(sizes, "image")
    share = (F.count(F.lit(1)) / F.first("pixels").cast("double")).alias("share")
    shares = known.groupBy("image", "dataset", "category", "label").agg(share).drop("image")
    if images is not None:
        whole = images.select("image", "dataset", "category", "label").distinct()
        shares = shares.unionByName(whole.select("dataset", "category", "label", F.lit(1.0).alias("share")))
    return shares.groupBy("dataset", "category", "label").agg(F.count(F.lit(1)).alias("frequency"), F.sum("share").alias("coverage"))


def frequent(stats: DataFrame, min_frequency: int, min_coverage: float) -> DataFrame:
    return stats.where((F.col("frequency") >= min_frequency) & (F.col("coverage") >= min_coverage))


def _falling(name: str) -> list[Column]:
    """By falling frequency, then coverage to six digits, as the last bits of a sum depend on its order, then name."""
    return [F.desc("frequency"), F.round("coverage", 6).desc(), F.col(name)]


def number_labels(stats: DataFrame, name: str = "label") -> DataFrame:
    """Dense numbers from 1 by falling frequency, then coverage to six digits, then name."""
    return numbered(stats, "number", *_falling(name))


def dense_codes(stats: DataFrame, name: str = "label") -> DataFrame:
    """Numbers from 1 inside each category, in the same order."""
    return stats.withColumn("code", F.row_number().over(Window.partitionBy("category").orderBy(*_falling(name))))


def category_statistics(labels: DataFrame) -> DataFrame:
    """First and last number, count and frequency of each category, in the order of the first number."""
    return labels.groupBy("category").agg(F.min("number").alias("first_number"), F.max("number").alias("last_number"), F.count(F.lit(1)).alias("n_labels"), F.sum("frequency").alias("frequency"))


def rekey(histogram: DataFrame, key: Column, value: str = "n") -> DataFrame:
    return histogram.groupBy(key.alias("key")).agg(F.sum(value).alias(value))


def invert(mapping: DataFrame, key: str, value: str) -> DataFrame:
    """value -> its keys, sorted."""
    return mapping.groupBy(value).agg(F.array_sort(F.collect_list(key)).alias("keys"))


def remap(rows: DataFrame, mapping: DataFrame, on: list[str], number: str = "number") -> DataFrame:
    """Left join to new numbers; what isn't mapped is background."""
    return rows.join(sent(mapping), on, "left").withColumn(number, F.coalesce(number, F.lit(0)))


def fill_dense(mapping: DataFrame, key: str, last: int, **defaults: object) -> DataFrame:
    """A row for every number from 0 to ``last``, with defaults where there was none."""
    spark = mapping.sparkSession
    full = spark.range(last + 1).select(F.col("id").cast(dict(mapping.dtypes)[key]).alias(key)).join(sent(mapping), key, "left")
    return full.select(key, *[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in mapping.columns if c != key])


def claims(names: DataFrame) -> DataFrame:
    """names: label, name, frequency. Each name goes to the most frequent label that has it; ties to the smaller label."""
    order = Window.partitionBy("name").orderBy(F.desc("frequency"), F.col("label"))
    return names.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("name", "label")


def resolve_names(labels: Iterable[tuple[str, list[str], int, float]]) -> dict[str, str]:
    """label key -> the name it ends up with. A fold over some thousand labels in order, on the driver.

    labels: key, names (already normalised, most preferred first), frequency, coverage. In the order of falling
    frequency each label claims all names that are free, and is called by the first one it owns. A label that owns none
    joins, of the labels that own its names, the one of the nearest mean size (then the more frequent, then the first
    by key), and takes that one's name.
    """
    ordered = sorted(labels, key=lambda x: (-x[2], x[0]))
    owner: dict[str, str] = {}
    facts = {key: (frequency, coverage) for key, _, frequency, coverage in ordered}
    called: dict[str, str] = {}
    for key, names, _, _ in ordered:
        for name in names:
            owner.setdefault(name, key)

    def size(key: str) -> float:
        frequency, coverage = facts[key]
        return coverage / frequency if frequency else 0.0

    for key, names, _, _ in ordered:
        own = [n for n in names if owner[n] == key]
        if own:
            called[key] = own[0]
        elif names:
            best = min({owner[n] for n in names}, key=lambda o: (abs(size(o) - size(key)), -facts[o][0], o))
            called[key] = called[best]
    return called


def called_names(labels: DataFrame) -> DataFrame:
    """``resolve_names`` on rows (key, names, frequency, coverage) without the driver: key, name.

    A name's owner is the first label in order that has it, so owners are a minimum per name; a label that owns none
    joins an owner, which by definition owns a name of its own.
    """
    size = F.when(F.col("frequency") > 0, F.col("coverage") / F.col("frequency")).otherwise(0.0)
    each = labels.select("key", "frequency", size.alias("size"), F.posexplode("names").alias("place", "name"))
    owners = each.groupBy("name").agg(F.min(F.struct((-F.col("frequency")).alias("rank"), F.col("key").alias("owner"), F.col("size").alias("owner_size"))).alias("o")).select("name", "o.*")
    met = each.join(owners, "name")
    own = met.where("owner = key").groupBy("key").agg(F.min_by("name", "place").alias("name"))
    lost = met.join(own.select("key"), "key", "left_anti")
    best = lost.groupBy("key").agg(F.min(F.struct(F.abs(F.col("owner_size") - F.col("size")).alias("far"), F.col("rank"), F.col("owner"))).alias("b")).select(F.col("key").alias("joined"), F.col("b.owner").alias("key"))
    return own.unionByName(best.join(own, "key").select(F.col("joined").alias("key"), "name"))


def split_of(hashed: Column, shares: list[tuple[str, float]]) -> Column:
    """The first split whose running share is at least the hash; shares must sum to one."""
    if abs(sum(s for _, s in shares) - 1) > 1e-9:
        raise ValueError("shares of splits must sum to 1")
    out: Column | None = None
    running = 0.0
    for name, share in shares[:-1]:
        running += share
        test = hashed <= F.lit(running)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    last = F.lit(shares[-1][0])
    return last if out is None else out.otherwise(last)
