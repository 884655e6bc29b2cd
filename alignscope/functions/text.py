"""Names of labels, layers and files as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_name(name: Column) -> Column:
    return F.lower(F.trim(F.replace(F.replace(name, F.lit(" - "), F.lit("-")), F.lit("/"), F.lit("-"))))


def real_name(name: Column) -> Column:
    """False for names that mean nothing: empty ones and dashes."""
    return name.isNotNull() & ~name.isin("", "-")


def fix_label(name: Column) -> Column:
    """A label for display: no -s or -c tail, underscores as spaces."""
    return F.replace(F.regexp_replace(name, r"-[sc]$", ""), F.lit("_"), F.lit(" "))


def print_label(name: Column) -> Column:
    """The plotting variant: underscores and dashes are spaces except in the last two characters; then -s and -c go."""
    head = F.translate(F.substring(name, F.lit(1), F.greatest(F.length(name) - 2, F.lit(0))), "_-", "  ")
    return F.regexp_replace(F.concat(head, F.right(name, F.least(F.lit(2), F.length(name)))), r"-[sc]", "")


def file_safe(blob: Column, dot_free: bool = False) -> Column:
    safe = F.regexp_replace(blob, r"[^\w.]+" if not dot_free else r"[^\w]+", "-")
    return F.btrim(safe, F.lit("-"))


def suffixed(name: Column, category: Column) -> Column:
    """Colours end in -c and scenes in -s, so that they never meet an object's name."""
    return F.concat(name, F.when(category == "color", F.lit("-c")).when(category == "scene", F.lit("-s")).otherwise(F.lit("")))


def scene_number(name: Column, number: Column) -> Column:
    """Scenes whose name starts with a tilde are background."""
    return F.when(F.startswith(name, F.lit("~")), F.lit(0)).otherwise(number)


def split_names(names: Column, pattern: str = r",\s*") -> Column:
    return F.filter(F.split(names, pattern), lambda x: x != "")


def parse_category_counts(text: Column) -> Column:
    """``cat(n);cat(n)`` as a map."""
    parts = F.filter(F.split(text, ";"), lambda x: x != "")
    return F.map_from_entries(F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^([^(]*)", 1), F.regexp_extract(x, r"\((\d+)\)", 1).cast("int"))))


def print_category_counts(entries: Column) -> Column:
    """array<struct<name, n>> as ``cat(n);cat(n)``."""
    return F.array_join(F.transform(entries, lambda e: F.concat(e["name"], F.lit("("), e["n"].cast("string"), F.lit(")"))), ";")


def seg_file(image: Column) -> Column:
    return F.regexp_replace(image, r"\.jpg$", "_seg.png")


def category_file(image: Column, category: Column, layer: Column) -> Column:
    """Name of a label image: the first layer of a category has no number."""
    stem = F.regexp_replace(image, r"\.jpg$", "")
    tail = F.when(layer == 0, F.lit("")).otherwise(F.concat(F.lit("_"), layer.cast("string")))
    return F.concat(stem, F.lit("_"), category, tail, F.lit(".png"))


def synonyms(names: Column, rules: dict[str, list[str]], omit: list[str]) -> Column:
    """Names with the preferred ones of the rules after them, without repeats and without confusing ones."""
    table = F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.flatten(F.transform(names, lambda n: F.coalesce(table[n], F.array().cast("array<string>"))))
    return F.array_except(F.array_distinct(F.concat(names, more)), F.array(*map(F.lit, omit)))


def collapse_adjectives(words: Column, adjectives: list[str], short: dict[str, str]) -> Column:
    """Short words spelled out and adjectives of position dropped."""
    table = F.create_map(*[F.lit(x) for kv in short.items() for x in kv])
    return F.array_join(F.array_except(F.transform(words, lambda w: F.coalesce(table[w], w)), F.array(*map(F.lit, adjectives))), " ")


#: Names of networks as they are printed, by the names that results are stored under.
NETWORKS = {
    "ref_alexnet_places": "AlexNet-Places205",
    "ref_alexnet_imagenet": "AlexNet-ImageNet",
    "ref_vgg16_places": "VGG-Places205",
    "ref_vgg16_imagenet": "VGG-ImageNet",
    "ref_googlenet_places": "GoogLeNet-Places205",
    "ref_googlenet_imagenet": "GoogLeNet-ImageNet",
}


def print_network(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in NETWORKS.items() for x in kv])
    return F.coalesce(table[name], name)
