"""Results for people: SVG bars, HTML pages, line graphs, provenance and alias lists, as lines of text or pictures.

Pages and bars are tables of lines (ord, value), made where the rows are; written in the order of ``ord`` they are a file.
"""

from __future__ import annotations

from html import escape

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import encode_png
from ..shared import numbered, sent


def _escape(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _lines(like: DataFrame, rows: list[tuple[float, str]]) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, "ord double, value string")


def bars_svg(histogram: DataFrame, height: int = 100, width: int = 12, gap: int = 2) -> DataFrame:
    """histogram: label, units, category, max_score. Vertical bars in order, one colour a category: ord, value."""
    bars = numbered(histogram, "place", F.desc("units"), F.desc("max_score"), "label")
    found = bars.agg(F.max("units").alias("top"), F.count(F.lit(1)).alias("n")).first()  # two numbers
    hues = numbered(bars.groupBy("category").agg(F.min("place").alias("first")), "hue", "first")
    kinds = max(hues.count(), 1)
    x = ((F.col("place") - 1) * (width + gap)).alias("x")
    tall = (F.col("units") / F.lit(found["top"] or 1) * height).alias("tall")
    rows = bars.join(sent(hues.select("category", "hue")), "category").select("place", _escape(F.col("label")).alias("label"), "units", x, tall, F.floor((F.col("hue") - 1) * 360 / kinds).alias("turn"))
    rect = F.format_string(f'<rect x="%d" y="%.3f" width="{width}" height="%.3f" fill="hsl(%d,60%%,55%%)"><title>%s: %d</title></rect>', "x", height - F.col("tall"), "tall", "turn", "label", "units")
    name = F.format_string(f'<text x="%d" y="{height + 8}" transform="rotate(60 %d {height + 8})" font-size="9">%s</text>', "x", "x", "label")
    lines = rows.select(F.col("place").cast("double").alias("ord"), F.concat(rect, name).alias("value"))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{found["n"] * (width + gap)}" height="{height + 90}">'
    return lines.unionByName(_lines(histogram, [(0.0, head), (float(found["n"] + 1), "</svg>")]))


def page(title: str, ordered: DataFrame, histogram: DataFrame, pictures: DataFrame | None = None) -> DataFrame:
    """A report of all units in order, after a headline and the histogram: ord, value.

    ordered: place, unit, label, category, score; pictures: unit, src (an overview picture of the unit's best images).
    """
    found = histogram.agg(F.sum("units").alias("u"), F.count(F.lit(1)).alias("c")).first()
    n = ordered.count()
    rows = ordered if pictures is None else ordered.join(pictures.select("unit", "src"), "unit", "left")
    shown = F.lit("") if pictures is None else F.coalesce(F.format_string('<br><img loading="lazy" src="%s">', _escape(F.col("src"))), F.lit(""))
    name = lambda c: F.coalesce(_escape(F.col(c).cast("string")), F.lit("-"))
    item = F.concat(F.format_string('<li value="%d">unit %d: %s (%s) %.9f', "place", F.col("unit") + 1, name("label"), name("category"), "score"), shown, F.lit("</li>"))
    units = rows.select((F.col("place") + 1e9).alias("ord"), item.alias("value"))
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><p>{found['u'] or 0}/{n} units cover {found['c']} concepts</p>"
    return units.unionByName(bars_svg(histogram)).unionByName(_lines(ordered, [(-1.0, head), (1e9, "<ol>"), (2e18, "</ol></body></html>")]))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in order as text files whose names sort as the lines do."""
    lines.orderBy("ord").select("value").write.text(path)


def line_graph(series: list[list[float]], height: int = 200, step: int = 40) -> bytes:
    """Curves of values from 0 to 1 as a PNG picture, one colour each: value v stands ``height * (1 - v)`` pixels down.

    Points are ``step`` pixels apart and drawn last; colour k is ``colour(k)`` on white.
    """
    width = step * max([len(s) - 1 for s in series], default=0) + 1
    picture = np.full((height + 1, width, 3), 255, np.uint8)
    for k, values in enumerate(series):
        at = step * np.arange(len(values))
        x = np.arange(at[-1] + 1 if len(at) else 0)
        y = np.interp(x, at, values) if len(at) else x
        picture[height - np.rint(np.clip(y, 0, 1) * height).astype(int), x] = colour(k)
    for k, values in enumerate(series):
        for i, v in enumerate(values):
            picture[height - int(np.rint(min(max(v, 0), 1) * height)), step * i] = colour(k)
    return encode_png(picture)


def colour(k: int) -> tuple[int, int, int]:
    """Different colours for up to some hundred curves, none of them white."""
    return (37 * k) % 200, (91 * k + 60) % 200, (151 * k + 120) % 200


def readme(facts: dict[str, object]) -> str:
    return "\n".join(f"{k}: {v}" for k, v in facts.items()) + "\n"


def alias_lines(names: DataFrame) -> DataFrame:
    """names: name, label. Names that several labels share, the most shared first: one line of text each."""
    shared = names.groupBy("name").agg(F.array_sort(F.collect_set("label")).alias("labels")).where(F.size("labels") > 1)
    ordered = shared.select((-F.size("labels")).alias("k"), "name", F.concat_ws(": ", "name", F.array_join("labels", "; ")).alias("value"))
    return ordered.orderBy("k", "name").select("value")
