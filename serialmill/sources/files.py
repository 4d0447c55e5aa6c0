"""Readers of the library's own files: rule tables, chapter lists inside pages, state documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "surface string, pos string, respell string, notes string"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: a rule CSV with a header and ``#`` comments; rows without a surface are dropped, ``TAG+lemma`` is split."""
    return rule_rows(spark.read.schema(RULES).option("header", True).option("comment", "#").option("ignoreLeadingWhiteSpace", True).csv(path))


def rule_rows(raw: DataFrame) -> DataFrame:
    pos = F.coalesce("pos", F.lit(""))
    lemma = F.when(F.contains(pos, F.lit("+")), F.substring_index(pos, "+", -1)).otherwise("")
    return raw.where(F.length(F.trim("surface")) > 0).select("surface", F.substring_index(pos, "+", 1).alias("pos"), lemma.alias("lemma"), F.coalesce("respell", F.lit("")).alias("respell"), F.coalesce("notes", F.lit("")).alias("notes"))


CHAPTER = "array<struct<id:string,volumeId:string,title:string,slug:string,date:string,order:int,isUnlocked:boolean>>"


def embedded_chapters(html: Column, name: str = "chapters") -> Column:
    """SRC4: the array assigned to ``window.<name>``. The JSON reader stops at the closing bracket; entries without a numeric id go."""
    text = F.regexp_extract(html, rf"(?s)window\.{name}\s*=\s*(\[.*)", 1)
    return F.filter(F.coalesce(F.from_json(text, CHAPTER), F.array().cast(CHAPTER)), lambda c: c["id"].rlike("^[0-9]+$"))


def toc_page_count(total: Column, per_page: int) -> Column:
    """SRC5: pages of a table of contents, at least one."""
    return F.greatest(F.lit(1), F.ceil(total / per_page)).cast("int")


_TOC = r'(?is)<li[^>]*class="toc_w"[^>]*order="([0-9]+)"[^>]*>(.*?)</li>'


def toc_rows(html: Column) -> Column:
    """SRC5: array<struct<ord, id, title, slug, published>> of a table of contents; entries without a place from 1 or a numeric id go."""
    items = F.regexp_extract_all(html, F.lit(r'(?is)<li[^>]*class="toc_w"[^>]*order="[0-9]+"[^>]*>.*?</li>'), F.lit(0))
    text = lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, r'(?is)<a[^>]*class="toc_a"[^>]*>(.*?)</a>', 1), "<[^>]*>", ""))
    slug = lambda x: F.regexp_replace(F.regexp_replace(F.lower(text(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    date = lambda x: F.try_to_timestamp(F.regexp_extract(x, r'(?is)class="fic_date_pub"[^>]*title="([^"]*)"', 1), F.lit("MMM d, yyyy hh:mm a"))
    row = lambda x: F.struct((F.regexp_extract(x, _TOC, 1).cast("int") - 1).alias("ord"), F.regexp_extract(x, "/chapter/([0-9]+)", 1).alias("id"), text(x).alias("title"), slug(x).alias("slug"), date(x).alias("published"))
    return F.filter(F.transform(items, row), lambda r: (r["ord"] >= 0) & (r["id"] != ""))


STATE = "schema int, uuid string, source_id string, rr_id string, provider string, title string, chapters array<struct<ord:int,source_id:string,status:string>>"


def read_state(spark: SparkSession, path: str, newest: int = 3, by_line: bool = False) -> DataFrame:
    """SRC7: state documents, one a file or (``by_line``) one a line. The legacy id is taken over; newer schemas and documents without a uuid are marked, not read."""
    return state_rows(spark.read.schema(STATE).option("multiLine", not by_line).json(path), newest)


def state_rows(raw: DataFrame, newest: int = 3) -> DataFrame:
    problem = F.when(F.coalesce("schema", F.lit(1)) > newest, "newer schema").when(F.coalesce("uuid", F.lit("")) == "", "no uuid")
    return raw.select("uuid", F.coalesce("source_id", "rr_id").alias("source_id"), "provider", "title", "chapters", problem.alias("problem"))
