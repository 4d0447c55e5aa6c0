"""Along the blocks of a chapter: machine-voice runs, and the title that a text says again at its top; as columns and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serialmill.functions import text as T


def machine_runs(blocks: DataFrame, key: str = "doc_id", marker: str = "//") -> DataFrame:
    """(key, block_no, piece, kind, machine, body). ``blocks``: key, block_no, kind, body, emphasised.

    Every piece has the change that comes right before it: a marker at a block's start opens the voice, one at its end closes it, any other turns it; a block that
    is no paragraph or box, and a plain paragraph without a marker (unless emphasised), closes it. The voice of a piece is the last opening
    or closing, turned as often as markers turned it since: running sums, no fold. The marker of a web address is none; pieces without a
    letter or digit beside a marker go."""
    spoken = F.col("kind").isin("paragraph", "system")
    cut = F.when(spoken, F.split("body", rf"(?<!:)\Q{marker}\E", -1)).otherwise(F.array("body"))
    b = blocks.select(key, "block_no", "kind", "emphasised", cut.alias("_p")).select("*", F.posexplode("_p").alias("piece", "body"))
    n, i = F.size("_p"), F.col("piece")
    opens = (i == 1) & (F.trim(F.get("_p", F.lit(0))) == "")
    shuts = (i == n - 1) & (F.regexp_replace("body", "^[ .!?…]+|[ .!?…]+$", "") == "")
    ends = (i == 0) & (~spoken | ((n == 1) & (F.col("kind") == "paragraph") & ~F.col("emphasised")))
    b = b.withColumn("_set", F.when(ends, False).when((i > 0) & opens, True).when((i > 0) & shuts, False)).withColumn("_turn", ((i > 0) & F.col("_set").isNull()).cast("int"))
    along = Window.partitionBy(key).orderBy("block_no", "piece").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_turns", F.sum("_turn").over(along))
    b = b.withColumn("_last", F.last(F.when(F.col("_set").isNotNull(), F.struct(F.col("_set").alias("on"), F.col("_turns").alias("turns"))), ignorenulls=True).over(along))
    turned = (F.col("_turns") - F.coalesce("_last.turns", F.lit(0))) % 2 == 1
    machine = F.coalesce("_last.on", F.lit(False)) != turned
    return b.where((n == 1) | F.col("body").rlike(r"[\p{L}\p{N}]")).select(key, "block_no", "piece", "kind", machine.alias("machine"), "body")


# Fixed value: a chapter number at the head of a title.
NUMBERED = r"(?is)^\s*(?:chapter|ch\.?)?\s*([0-9]{1,4})\s*[-–—:.)]*\s*(.*)$"


def squash(text: Column) -> Column:
    """Lower case, with one space for every run of what is no letter or digit."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def title_forms(title: Column) -> Column:
    """All ways to write a title: its name, its number in digits and in words, with and without "chapter", alone and before the name."""
    numbered = title.rlike(NUMBERED)
    number = F.when(numbered, F.regexp_extract(title, NUMBERED, 1).cast("int"))
    name = squash(F.when(numbered, F.regexp_extract(title, NUMBERED, 2)).otherwise(title))
    written = F.array(number.cast("string"), squash(T.number_words(number)))
    heads = F.when(numbered, F.concat(written, F.transform(written, lambda n: F.concat(F.lit("chapter "), n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(F.array(name), heads, F.transform(heads, lambda h: F.concat(h, F.lit(" "), name))), lambda f: F.trim(f) != ""))


def leading_echoes(blocks: Column, title: Column, most: int = 4, longest: int = 120, alike: float = 0.85) -> Column:
    """How many leading blocks (array<struct<kind, body>>) only repeat the title; the first that does not ends the count. Forms of more than six letters may
    differ by a typo: an edit distance of at most 0.15 of the longer one."""
    forms = title_forms(title)
    near = lambda said, f: (said == f) | ((F.length(f) > 6) & (1 - F.levenshtein(said, f) / F.greatest(F.length(said), F.length(f)) >= alike))
    fits = lambda b: b["kind"].isin("paragraph", "heading") & (F.length(b["body"]) <= longest) & T.bound(squash(b["body"]), lambda said: (said != "") & F.exists(forms, lambda f: near(said, f)))
    flags = F.transform(F.slice(blocks, 1, most), lambda b: F.coalesce(fits(b), F.lit(False)))
    return F.when(F.array_contains(flags, F.lit(False)), F.array_position(flags, F.lit(False)) - 1).otherwise(F.size(flags)).cast("int")


def without_title(blocks: Column, title: Column) -> Column:
    return F.slice(blocks, leading_echoes(blocks, title) + 1, F.greatest(F.size(blocks), F.lit(1)))

