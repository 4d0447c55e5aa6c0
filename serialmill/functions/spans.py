"""Spans of text as sorted arrays of struct<a, b> (character places from 0, end exclusive): merged, clipped, re-based through every cut."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from serialmill.functions import text as T

SPANS = "array<struct<a:int,b:int>>"


def none() -> Column:
    return F.array().cast(SPANS)


def span(a: Column, b: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))


def merged(spans: Column) -> Column:
    """Sorted spans without empty ones; overlapping and touching ones are joined."""
    kept = F.array_sort(F.filter(spans, lambda s: s["b"] > s["a"]))
    start = F.struct(none().alias("done"), F.lit(None).cast("struct<a:int,b:int>").alias("open"))
    step = lambda acc, s: F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), span(s["a"], s["b"]).alias("open"))).when(
        s["a"] <= acc["open"]["b"], F.struct(acc["done"].alias("done"), span(acc["open"]["a"], F.greatest(acc["open"]["b"], s["b"])).alias("open"))
    ).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), span(s["a"], s["b"]).alias("open")))
    return F.aggregate(kept, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def rebased(spans: Column, lo: Column, hi: Column) -> Column:
    """The spans inside the slice from ``lo`` to ``hi``, counted from its start."""
    return F.transform(F.filter(spans, lambda s: F.least(s["b"], hi) > F.greatest(s["a"], lo)), lambda s: span(F.greatest(s["a"], lo) - lo, F.least(s["b"], hi) - lo))


def covered(spans: Column) -> Column:
    """How many characters merged spans cover."""
    return F.aggregate(spans, F.lit(0), lambda n, s: n + s["b"] - s["a"])


def placed(parts: Column) -> Column:
    """array<struct<start, part>>: each part with the length of all before it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,part:string>>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), x.alias("part")))).alias("out"))
    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def sentences(text: Column) -> Column:
    """array<struct<start, body>>: the sentences of ``T.sentences`` with their places. Cuts are put in without taking a character out, so places are running lengths."""
    parts = placed(F.split(F.regexp_replace(text, T.END_KEPT, "$1$2" + T.CUT), T.CUT))
    trimmed = F.transform(parts, lambda p: F.struct((p["start"] + F.length(p["part"]) - F.length(F.ltrim(p["part"]))).alias("start"), F.trim(p["part"]).alias("body")))
    return F.filter(trimmed, lambda p: p["body"] != "")


def tagged_text(html: Column, tag: str = "b") -> Column:
    """struct<text, spans> of a stretch of HTML: its text without tags, and the spans of what comes between <tag> and the next tag."""
    bits = F.regexp_extract_all(html, F.lit("<[^>]*>|[^<]+|<"), F.lit(0))
    is_tag = lambda x: x.rlike("^<[^>]*>$")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), none().alias("spans"))
    step = lambda acc, x: F.when(is_tag(x), F.struct(acc["at"].alias("at"), x.alias("last"), acc["spans"].alias("spans"))).otherwise(F.struct(
        (acc["at"] + F.length(x)).alias("at"), F.lit("").alias("last"), F.when(acc["last"] == f"<{tag}>", F.concat(acc["spans"], F.array(span(acc["at"], acc["at"] + F.length(x))))).otherwise(acc["spans"]).alias("spans")))
    return F.struct(F.array_join(F.filter(bits, lambda x: ~is_tag(x)), "").alias("text"), merged(F.aggregate(bits, start, step)["spans"]).alias("spans"))
