"""Library state: selections, chapter merges, counts, estimates and cache reachability over chapter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from serialmill.functions.order import placed
from serialmill.sources import files
from serialmill.sources.bindings import CACHE_SQL, CHAPTERS_SQL, SERIES_SQL, cache_entries, chapters, series, stage_rank, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

RANK_SQL = "CASE status WHEN 'new' THEN 0 WHEN 'fetched' THEN 1 WHEN 'parsed' THEN 2 WHEN 'rendered' THEN 3 ELSE -1 END"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


# --- filters


def outstanding_rows(ch: DataFrame, stage: str = "rendered") -> DataFrame:
    """Unlocked, not skipped, and in error or below the wanted stage."""
    want = {"fetched": 1, "parsed": 2, "rendered": 3}[stage]
    return ch.where(F.col("unlocked") & (F.col("status") != "skipped") & ((F.col("status") == "error") | (stage_rank(F.col("status")) < want)))


OUT_SQL = f"out AS (SELECT * FROM chapters WHERE unlocked AND status <> 'skipped' AND (status = 'error' OR {RANK_SQL} < 3))"


@query("flt11_outstanding", _with(CHAPTERS_SQL, OUT_SQL) + "SELECT series, source_id, n, status FROM out")
def outstanding(spark: SparkSession, d: str) -> DataFrame:
    return outstanding_rows(chapters(spark, d)).select("series", "source_id", "n", "status")


@query("flt12_selection", _with(CHAPTERS_SQL, OUT_SQL) + "SELECT 'explicit' AS mode, series, source_id FROM chapters WHERE n BETWEEN 2 AND 4 UNION ALL SELECT 'implicit', series, source_id FROM out")
def selection(spark, d):
    ch = chapters(spark, d)
    explicit = ch.where(F.col("n").between(2, 4)).select(F.lit("explicit").alias("mode"), "series", "source_id")
    return explicit.unionByName(outstanding_rows(ch).select(F.lit("implicit").alias("mode"), "series", "source_id"))


@query("flt13_playable_series", _with(CHAPTERS_SQL) + "SELECT series, count(*) AS n_playable, min(n) AS first_n, max(n) AS last_n FROM chapters WHERE status = 'rendered' GROUP BY series")
def playable(spark, d):
    return chapters(spark, d).where("status = 'rendered'").groupBy("series").agg(F.count("*").alias("n_playable"), F.min("n").alias("first_n"), F.max("n").alias("last_n"))


@query("flt17_rendered_range", _with(CHAPTERS_SQL) + "SELECT series, source_id, n FROM chapters WHERE status = 'rendered' AND n BETWEEN 2 AND 9")
def rendered_range(spark, d):
    return chapters(spark, d).where("status = 'rendered' AND n BETWEEN 2 AND 9").select("series", "source_id", "n")


@query("flt19_bulk_status", _with(CHAPTERS_SQL) + "SELECT series, source_id, CASE WHEN status = 'error' THEN 'new' WHEN status = 'new' AND n <= 3 THEN 'skipped' ELSE status END AS status FROM chapters")
def bulk_status(spark, d):
    """Errors are reset to new; of the first three chapters, new ones are skipped."""
    s = F.when(F.col("status") == "error", "new").when((F.col("status") == "new") & (F.col("n") <= 3), "skipped").otherwise(F.col("status"))
    return chapters(spark, d).select("series", "source_id", s.alias("status"))


ALIAS_SQL = "aliases AS (SELECT series, 'old-' || slug AS slug FROM series WHERE series % 2 = 0)"


def aliases(spark, d) -> DataFrame:
    """Former slugs, which still lead to their series: here of every second one."""
    return series(spark, d).where("series % 2 = 0").select("series", F.concat(F.lit("old-"), "slug").alias("slug"))


@query("flt20_slug_taken", _with(SERIES_SQL, ALIAS_SQL) + """,
w AS (SELECT series, CASE series % 3 WHEN 0 THEN 'customer-' || lpad((series + 1)::VARCHAR, 9, '0') WHEN 1 THEN 'old-customer-' || lpad((series + 1)::VARCHAR, 9, '0') ELSE slug END AS slug FROM series)
SELECT w.series, w.slug, EXISTS (SELECT 1 FROM (SELECT series, slug FROM series UNION ALL SELECT * FROM aliases) o WHERE o.slug = w.slug AND o.series <> w.series) AS taken FROM w""")
def slug_taken(spark, d):
    """A slug is taken if another series has it, now or as an alias."""
    s = series(spark, d)
    after = F.lpad((F.col("series") + 1).cast("string"), 9, "0")
    slug = F.when(F.col("series") % 3 == 0, F.concat(F.lit("customer-"), after)).when(F.col("series") % 3 == 1, F.concat(F.lit("old-customer-"), after)).otherwise(F.col("slug"))
    wanted = s.select("series", slug.alias("slug"))
    others = s.select("series", "slug").unionByName(aliases(spark, d)).withColumnRenamed("series", "owner")
    hit = wanted.join(others, "slug").where("owner <> series").select("series").distinct().withColumn("hit", F.lit(True))
    return wanted.join(hit, "series", "left").select("series", "slug", F.coalesce("hit", F.lit(False)).alias("taken"))


# --- merges


def _old(ch: DataFrame) -> DataFrame:
    return ch.where("source_id % 5 <> 0")


def _new(ch: DataFrame) -> DataFrame:
    """The next listing: some chapters are gone, some are new, titles of a few are blank."""
    return ch.where("source_id % 7 <> 0").withColumn("title", F.when(F.col("source_id") % 11 == 0, "").otherwise(F.concat(F.lit("Chapter "), F.col("n").cast("string"))))


MERGE_SQL = """old AS (SELECT *, 'Old ' || n AS title FROM chapters WHERE source_id % 5 <> 0),
new AS (SELECT *, CASE WHEN source_id % 11 = 0 THEN '' ELSE 'Chapter ' || n END AS title FROM chapters WHERE source_id % 7 <> 0)"""


@query("joi7_chapter_merge", _with(CHAPTERS_SQL, MERGE_SQL) + """
SELECT coalesce(o.series, w.series) AS series, coalesce(o.source_id, w.source_id) AS source_id, coalesce(o.status, 'new') AS status,
  coalesce(nullif(w.title, ''), o.title, '') AS title, o.source_id IS NULL AS is_new, w.source_id IS NULL AS dropped
FROM old o FULL JOIN new w ON o.series = w.series AND o.source_id = w.source_id""")
def chapter_merge(spark, d):
    """Status survives, listed fields are refreshed, a blank field keeps the old value."""
    ch = chapters(spark, d)
    o = _old(ch).select("series", "source_id", F.col("status").alias("o_status"), F.concat(F.lit("Old "), F.col("n").cast("string")).alias("o_title"), F.lit(True).alias("had"))
    w = _new(ch).select("series", "source_id", F.col("title").alias("w_title"), F.lit(True).alias("has"))
    blank = F.when(F.col("w_title") != "", F.col("w_title"))
    return o.join(w, ["series", "source_id"], "full").select(
        "series", "source_id", F.coalesce("o_status", F.lit("new")).alias("status"), F.coalesce(blank, "o_title", F.lit("")).alias("title"), F.col("had").isNull().alias("is_new"), F.col("has").isNull().alias("dropped")
    )


@query("set1_new_chapters", _with(CHAPTERS_SQL, MERGE_SQL) + "SELECT w.series, count(*) AS n_new FROM new w ANTI JOIN old o ON o.series = w.series AND o.source_id = w.source_id GROUP BY w.series")
def new_chapters(spark, d):
    ch = chapters(spark, d)
    return _new(ch).select("series", "source_id").join(_old(ch).select("series", "source_id"), ["series", "source_id"], "left_anti").groupBy("series").agg(F.count("*").alias("n_new"))


@query("joi8_volume_merge", _with(CHAPTERS_SQL) + """
SELECT coalesce(o.series, w.series) AS series, coalesce(o.volume, w.volume) AS volume, coalesce(w.n, o.n) AS n_chapters, o.series IS NULL AS is_new
FROM (SELECT series, volume, count(*) AS n FROM chapters WHERE source_id % 5 <> 0 GROUP BY 1, 2) o
FULL JOIN (SELECT series, volume, count(*) AS n FROM chapters WHERE source_id % 7 <> 0 GROUP BY 1, 2) w ON o.series = w.series AND o.volume = w.volume""")
def volume_merge(spark, d):
    ch = chapters(spark, d)
    count = lambda df, name: df.groupBy("series", "volume").agg(F.count("*").alias(name))
    both = count(_old(ch), "o").join(count(_new(ch), "w"), ["series", "volume"], "full")
    return both.select("series", "volume", F.coalesce("w", "o").alias("n_chapters"), F.col("o").isNull().alias("is_new"))


@query("joi9_reslot_dropped", _with(CHAPTERS_SQL, MERGE_SQL) + """,
live AS (SELECT series, source_id, ord AS live_ord, published, max(published) OVER (PARTITION BY series ORDER BY ord) AS k FROM new),
kept AS (SELECT o.series, o.source_id, o.ord, o.published FROM old o ANTI JOIN new w ON o.series = w.series AND o.source_id = w.source_id),
al AS (SELECT series, source_id, k, 1 AS side, NULL::TIMESTAMP AS d, live_ord AS o FROM live UNION ALL SELECT series, source_id, published, 0, published, ord FROM kept)
SELECT series, source_id, row_number() OVER (PARTITION BY series ORDER BY k, side, d, o) - 1 AS place, side = 0 AS dropped FROM al""")
def reslot(spark, d):
    """Chapters that the source dropped go before the first live one whose date is not earlier; places are contiguous."""
    ch = chapters(spark, d)
    run = Window.partitionBy("series").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    live = _new(ch).select("series", "source_id", F.max("published").over(run).alias("k"), F.lit(1).alias("side"), F.lit(None).cast("timestamp_ntz").alias("d"), "ord")
    gone = _old(ch).join(_new(ch).select("series", "source_id"), ["series", "source_id"], "left_anti")
    kept = gone.select("series", "source_id", F.col("published").alias("k"), F.lit(0).alias("side"), F.col("published").cast("timestamp_ntz").alias("d"), "ord")
    place = F.row_number().over(Window.partitionBy("series").orderBy("k", "side", "d", "ord")) - 1
    return live.unionByName(kept).select("series", "source_id", place.alias("place"), (F.col("side") == 0).alias("dropped"))


@query("joi6_series_upsert", _with(SERIES_SQL) + """
SELECT coalesce(o.series, w.series) AS series, coalesce(o.slug, w.slug) AS slug, coalesce(nullif(w.title, ''), o.title) AS title, coalesce(w.tag, o.tag) AS tag
FROM (SELECT * FROM series WHERE series % 4 <> 0) o
FULL JOIN (SELECT series, slug || '-new' AS slug, CASE WHEN series % 6 = 0 THEN '' ELSE upper(title) END AS title, tag FROM series WHERE series % 9 <> 0) w ON o.series = w.series""")
def series_upsert(spark, d):
    s = series(spark, d)
    o = s.where("series % 4 <> 0").select("series", F.col("slug").alias("o_slug"), F.col("title").alias("o_title"), F.col("tag").alias("o_tag"))
    w = s.where("series % 9 <> 0").select("series", F.concat("slug", F.lit("-new")).alias("w_slug"), F.when(F.col("series") % 6 == 0, None).otherwise(F.upper("title")).alias("w_title"), F.col("tag").alias("w_tag"))
    return o.join(w, "series", "full").select("series", F.coalesce("o_slug", "w_slug").alias("slug"), F.coalesce("w_title", "o_title").alias("title"), F.coalesce("w_tag", "o_tag").alias("tag"))


@query("joi16_range_selection", _with(CHAPTERS_SQL) + """
SELECT DISTINCT series, source_id, n FROM chapters JOIN (VALUES (1, 3), (7, 7), (20, NULL), (2, 4)) s(lo, hi) ON n BETWEEN coalesce(lo, 1) AND coalesce(hi, 2147483647)""")
def range_selection(spark, d):
    spans = spark.createDataFrame([(1, 3), (7, 7), (20, None), (2, 4)], "lo int, hi int")  # a fixed few rows
    on = F.col("n").between(F.coalesce("lo", F.lit(1)), F.coalesce("hi", F.lit(2**31 - 1)))
    return chapters(spark, d).join(F.broadcast(spans), on, "left_semi").select("series", "source_id", "n")


@query("joi10_volume_enrichment", _with(CHAPTERS_SQL) + """,
v AS (SELECT series, volume, row_number() OVER (PARTITION BY series ORDER BY volume) AS idx FROM (SELECT DISTINCT series, volume FROM chapters WHERE volume NOT LIKE '5%'))
SELECT c.series, c.source_id, v.idx AS volume_idx FROM chapters c LEFT JOIN v ON v.series = c.series AND v.volume = c.volume""")
def volume_enrichment(spark, d):
    """WIN2's contiguous volume numbers joined to chapters; chapters without a volume keep null."""
    ch = chapters(spark, d)
    vols = ch.where("volume NOT LIKE '5%'").select("series", "volume").distinct()
    idx = vols.withColumn("volume_idx", F.row_number().over(Window.partitionBy("series").orderBy("volume")))
    return ch.join(idx, ["series", "volume"], "left").select("series", "source_id", "volume_idx")


@query("joi25_missing_bundles", _with(SERIES_SQL, CHAPTERS_SQL) + "SELECT s.series, s.slug FROM series s ANTI JOIN (SELECT DISTINCT series FROM chapters WHERE status = 'rendered') c ON c.series = s.series")
def missing_bundles(spark, d):
    seen = chapters(spark, d).where("status = 'rendered'").select("series").distinct()
    return series(spark, d).join(seen, "series", "left_anti").select("series", "slug")


@query("joi17_identity_match", _with(SERIES_SQL) + """,
inc AS (SELECT series AS inc_id, CASE WHEN series % 2 = 0 THEN md5(series::VARCHAR) END AS uuid, provider, title FROM series WHERE series % 3 <> 0),
cur AS (SELECT series, md5(series::VARCHAR) AS uuid, provider, title FROM series WHERE series % 5 <> 0)
SELECT inc_id, coalesce(a.series, b.series) AS matched FROM inc LEFT JOIN cur a ON a.uuid = inc.uuid LEFT JOIN cur b ON b.provider = inc.provider AND b.title = inc.title""")
def identity_match(spark, d):
    """By uuid first, else by provider and source id."""
    s = series(spark, d)
    inc = s.where("series % 3 <> 0").select(F.col("series").alias("inc_id"), F.when(F.col("series") % 2 == 0, F.md5(F.col("series").cast("string"))).alias("uuid"), "provider", "title")
    cur = s.where("series % 5 <> 0")
    a = cur.select(F.md5(F.col("series").cast("string")).alias("uuid"), F.col("series").alias("m1"))
    b = cur.select("provider", "title", F.col("series").alias("m2"))
    return inc.join(a, "uuid", "left").join(b, ["provider", "title"], "left").select("inc_id", F.coalesce("m1", "m2").alias("matched"))


GRAM = 8


def resolve(keys: DataFrame, known: DataFrame, alias: DataFrame) -> DataFrame:
    """Each key's series and the rank of its match: exact slug 0, alias 1, prefix 2, part of the slug 3, part of the title 4; the best, then the lowest id.

    ``keys``: want, key; ``known``: series, slug, title; ``alias``: series, slug. Each distinct key is resolved once, all by equal values: by slug, by alias, and
    only then as a part of a name. Such a key is compared with the names that hold the rarest of its own grams of GRAM characters (of the key itself, if it has fewer).
    """
    asked = keys.where("key <> ''").select("key").distinct()
    exact = asked.join(known.select("series", F.col("slug").alias("key")), "key").groupBy("key").agg(F.min("series").alias("series")).select("key", F.lit(0).alias("r"), "series")
    former = asked.join(alias.select("series", F.col("slug").alias("key")), "key").groupBy("key").agg(F.min("series").alias("series")).select("key", F.lit(1).alias("r"), "series")
    sure = exact.unionByName(former)
    left = asked.join(sure, "key", "left_anti").withColumn("n", F.least(F.length("key"), F.lit(GRAM)))
    cut = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.lower(F.substring(c, i, n))))
    own = left.select("key", F.explode(cut(F.col("key"), F.col("n"))).alias("gram"))
    sizes = F.broadcast(left.select("n").distinct())  # GRAM rows at most
    name = F.lower(F.concat_ws("\u0001", "slug", "title"))
    spread = known.select("series", "slug", "title", name.alias("name")).join(sizes, F.length("name") >= F.col("n"))
    grams = spread.select("series", "slug", "title", F.explode(cut(F.col("name"), F.col("n"))).alias("gram"))
    count = grams.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    rarest = own.join(count, "gram", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("m")).where("m.names > 0").select("key", "m.gram")
    rank = F.when(F.col("slug").startswith(F.col("key")), 2).when(F.contains("slug", "key"), 3).when(F.contains(F.lower("title"), F.lower("key")), 4)
    part = rarest.join(grams, "gram").select("key", rank.alias("r"), "series").where("r IS NOT NULL")
    best = sure.unionByName(part).groupBy("key").agg(F.min(F.struct("r", "series")).alias("m"))
    return keys.join(best, "key").select("want", "key", F.col("m.series").alias("found"), F.col("m.r").alias("match_rank"))


@query("joi15_alias_resolution", _with(SERIES_SQL, ALIAS_SQL) + """,
k AS (SELECT series AS want, CASE series % 5 WHEN 0 THEN slug WHEN 1 THEN 'old-' || slug WHEN 2 THEN substr(slug, 1, 17) WHEN 3 THEN substr(title, 10) ELSE substr(title, 5, 9) END AS key FROM series),
c AS (SELECT want, key, s.series, CASE WHEN s.slug = key THEN 0 WHEN starts_with(s.slug, key) THEN 2 WHEN contains(s.slug, key) THEN 3 WHEN contains(lower(s.title), lower(key)) THEN 4 END AS r FROM k, series s),
m AS (SELECT * FROM c WHERE r IS NOT NULL UNION ALL SELECT want, key, a.series, 1 FROM k JOIN aliases a ON a.slug = key)
SELECT want, key, series AS found, r AS match_rank FROM m QUALIFY row_number() OVER (PARTITION BY want ORDER BY r, series) = 1""")
def alias_resolution(spark, d):
    """Every series is asked for by its slug, a former one, a part of its slug or a part of its title."""
    s = series(spark, d)
    r = F.col("series") % 5
    key = F.when(r == 0, F.col("slug")).when(r == 1, F.concat(F.lit("old-"), "slug")).when(r == 2, F.substring("slug", 1, 17)).when(r == 3, F.expr("substring(title, 10)")).otherwise(F.substring("title", 5, 9))
    return resolve(s.select(F.col("series").alias("want"), key.alias("key")), s.select("series", "slug", "title"), aliases(spark, d))


@query("joi28_cascade_delete", _with(CHAPTERS_SQL) + """
SELECT series, count(*) AS n_removed, 0::BIGINT AS n_kept FROM chapters WHERE series % 10 = 0 GROUP BY series
UNION ALL SELECT series, 0, count(*) FROM chapters WHERE series % 10 <> 0 GROUP BY series""")
def cascade_delete(spark, d):
    """Removing a series removes its chapters; both sides are reported."""
    ch = chapters(spark, d)
    gone = series(spark, d).where("series % 10 = 0").select("series")
    n = lambda df, removed: df.groupBy("series").agg((F.count("*") if removed else F.lit(0).cast("bigint")).alias("n_removed"), (F.lit(0).cast("bigint") if removed else F.count("*")).alias("n_kept"))
    return n(ch.join(gone, "series", "left_semi"), True).unionByName(n(ch.join(gone, "series", "left_anti"), False))


@query("joi30_rename", _with(SERIES_SQL) + """,
own AS (SELECT series, CASE series % 8 WHEN 1 THEN 'vol-' || slug WHEN 5 THEN 'first-' || slug END AS alias FROM series), moved AS (SELECT series, CASE WHEN series % 4 = 1 THEN 'vol-' || slug ELSE slug END AS slug, slug AS was FROM series)
SELECT m.series, m.slug, array_to_string(list_sort(list_distinct([x FOR x IN [o.alias, CASE WHEN m.slug <> m.was THEN m.was END] IF x IS NOT NULL AND x <> m.slug])), ',') AS aliases FROM moved m JOIN own o USING (series)""")
def rename(spark, d):
    """A renamed series keeps its old slug as an alias, and an alias of its own that it now takes as its slug goes."""
    r = F.col("series")
    slug = F.when(r % 4 == 1, F.concat(F.lit("vol-"), "slug")).otherwise(F.col("slug"))
    own = F.when(r % 8 == 1, F.concat(F.lit("vol-"), "slug")).when(r % 8 == 5, F.concat(F.lit("first-"), "slug"))
    s = series(spark, d).select("series", slug.alias("now"), "slug", own.alias("own"))
    kept = F.filter(F.array("own", F.when(F.col("now") != F.col("slug"), F.col("slug"))), lambda x: x.isNotNull() & (x != F.col("now")))
    return s.select("series", F.col("now").alias("slug"), F.array_join(F.array_sort(F.array_distinct(kept)), ",").alias("aliases"))


PAGE_ROWS = 4

#: A walk over listed pages: most lists have grown by a few chapters, some were renumbered, some are not known at all, some are said to be longer than they are.
WALK_SQL = CHAPTERS_SQL + f""", sized AS (SELECT *, count(*) OVER (PARTITION BY series) AS total FROM chapters),
listed AS (SELECT series, source_id, ord, (total - 1 - ord) // {PAGE_ROWS} AS page FROM sized),
known AS (SELECT series, source_id, CASE WHEN series % 7 = 3 AND ord >= 2 THEN ord + 1 ELSE ord END AS ord FROM sized WHERE series % 7 <> 5 AND ord < total - series % 5),
said AS (SELECT series, max(total) + (series % 11 = 0)::INT AS total FROM sized GROUP BY series)"""


def walked(spark, d: str):
    """(listed: series, source_id, ord, page), (known: series, source_id, ord), (said: series, total)."""
    ch = chapters(spark, d)
    sized = ch.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("series")))
    listed = sized.select("series", "source_id", "ord", F.floor((F.col("total") - 1 - F.col("ord")) / PAGE_ROWS).cast("int").alias("page"))
    place = F.when((F.col("series") % 7 == 3) & (F.col("ord") >= 2), F.col("ord") + 1).otherwise(F.col("ord"))
    known = sized.where("series % 7 <> 5 AND ord < total - series % 5").select("series", "source_id", place.alias("ord"))
    return listed, known, ch.groupBy("series").agg((F.count(F.lit(1)) + F.when(F.col("series") % 11 == 0, 1).otherwise(0)).alias("total"))


def toc_walk(listed: DataFrame, known: DataFrame, said: DataFrame) -> DataFrame:
    """JOI24: (series, outcome, pages_read, n_chapters), pages newest first. The walk ends at the first page that is settled (it overlaps what is known, and all its
    chapters are where they were or past the end) if what is known and seen then adds up to ``total`` places without a gap: ``early``. Else all pages must add up by themselves: ``full``, or it is ``incomplete``.

    Whether the places add up is followed page by page without looking at a list twice: every page moves chapters out of places and into others, and
    running sums along the pages of a place, then of a series, tell how many places hold exactly one."""
    k = known.select("series", "source_id", F.col("ord").alias("was"))
    top = known.groupBy("series").agg(F.max("ord").alias("top"))
    rows = listed.join(k, ["series", "source_id"], "left").join(top, "series", "left")
    fits = F.when(F.col("was").isNotNull(), F.col("was") == F.col("ord")).otherwise(F.col("ord") > F.coalesce("top", F.lit(-1)))
    pages = rows.groupBy("series", "page").agg((F.bool_or(F.col("was").isNotNull()) & F.bool_and(fits)).alias("settled"))
    into = rows.select("series", "page", F.col("ord").alias("place"), F.lit(1).alias("moved"))
    out = rows.where("was IS NOT NULL").select("series", "page", F.col("was").alias("place"), F.lit(-1).alias("moved"))
    before = k.select("series", F.lit(-1).alias("page"), F.col("was").alias("place"), F.lit(1).alias("moved"))
    moves = into.unionByName(out).unionByName(before).groupBy("series", "place", "page").agg(F.sum("moved").alias("moved")).join(said, "series")
    at = Window.partitionBy("series", "place").orderBy("page")
    held = F.sum("moved").over(at.rowsBetween(Window.unboundedPreceding, 0))
    one = ((held == 1) & F.col("place").between(0, F.col("total") - 1)).cast("int")
    steps = moves.withColumn("one", one)
    steps = steps.withColumn("gained", F.col("one") - F.coalesce(F.lag("one").over(at), F.lit(0))).groupBy("series", "page").agg(F.sum("moved").alias("moved"), F.sum("gained").alias("gained"))
    along = Window.partitionBy("series").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.select("series", "page", F.sum("moved").over(along).alias("n"), F.sum("gained").over(along).alias("n_single"))
    stops = pages.join(sums, ["series", "page"]).join(said, "series").where("settled AND n = total AND n_single = total")
    early = stops.groupBy("series").agg(F.min("page").alias("page"))
    whole = listed.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ord").alias("places"), F.min("ord").alias("lo"), F.max("ord").alias("hi"), (F.max("page") + 1).alias("pages"))
    j = said.join(whole, "series", "left").join(early, "series", "left")
    full = (F.col("n") == F.col("total")) & (F.col("places") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)
    outcome = F.when(F.col("page").isNotNull(), "early").when(F.coalesce(full, F.lit(False)), "full").otherwise("incomplete")
    read = F.coalesce(F.col("page") + 1, F.col("pages"), F.lit(0)).cast("int")
    return j.select("series", outcome.alias("outcome"), read.alias("pages_read"), F.when(outcome != "incomplete", F.col("total")).alias("n_chapters"))


@query("joi24_toc_merge", "WITH " + WALK_SQL + """,
p AS (SELECT l.series, l.page, bool_or(k.ord IS NOT NULL) AND bool_and(CASE WHEN k.ord IS NOT NULL THEN k.ord = l.ord ELSE l.ord > coalesce((SELECT max(ord) FROM known x WHERE x.series = l.series), -1) END) AS settled
  FROM listed l LEFT JOIN known k ON k.series = l.series AND k.source_id = l.source_id GROUP BY l.series, l.page),
m AS (SELECT p.series, p.page, l.ord FROM p JOIN listed l ON l.series = p.series AND l.page <= p.page WHERE settled
  UNION ALL SELECT p.series, p.page, k.ord FROM p JOIN known k ON k.series = p.series WHERE settled AND NOT EXISTS (SELECT 1 FROM listed l WHERE l.series = k.series AND l.source_id = k.source_id AND l.page <= p.page)),
e AS (SELECT series, min(page) AS page FROM (SELECT series, page FROM m JOIN said USING (series) GROUP BY series, page, total HAVING count(*) = total AND count(DISTINCT ord) = total AND min(ord) = 0 AND max(ord) = total - 1) GROUP BY series),
f AS (SELECT series, count(*) = any_value(total) AND count(DISTINCT ord) = count(*) AND min(ord) = 0 AND max(ord) = count(*) - 1 AS whole, max(page) + 1 AS pages FROM listed JOIN said USING (series) GROUP BY series)
SELECT series, CASE WHEN page IS NOT NULL THEN 'early' WHEN whole THEN 'full' ELSE 'incomplete' END AS outcome, coalesce(page + 1, pages)::INT AS pages_read, CASE WHEN page IS NOT NULL OR whole THEN total END AS n_chapters
FROM said LEFT JOIN e USING (series) LEFT JOIN f USING (series)""")
def toc_merge(spark, d):
    """Listed pages merged with the known list, read only as far as needed."""
    return toc_walk(*walked(spark, d))


# --- aggregates


@query("agg11_series_summary", _with(CHAPTERS_SQL, OUT_SQL) + """
SELECT c.series, count(*) AS n_total, count(*) FILTER (status = 'new') AS n_new, count(*) FILTER (status = 'rendered') AS n_rendered, count(*) FILTER (status = 'error') AS n_error,
  count(*) FILTER (status = 'skipped') AS n_skipped, (SELECT count(*) FROM out o WHERE o.series = c.series) AS n_pending, (SELECT min(n) FROM out o WHERE o.series = c.series) AS next_n, max(n) FILTER (status = 'rendered') AS last_rendered_n
FROM chapters c GROUP BY c.series""")
def series_summary(spark, d):
    is_out = F.col("unlocked") & (F.col("status") != "skipped") & (F.col("status") != "rendered")
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return chapters(spark, d).groupBy("series").agg(
        F.count("*").alias("n_total"), count("new"), count("rendered"), count("error"), count("skipped"), F.count_if(is_out).alias("n_pending"), F.min(F.when(is_out, F.col("n"))).alias("next_n"), F.max(F.when(F.col("status") == "rendered", F.col("n"))).alias("last_rendered_n")
    )


FALLBACK_SECONDS, FALLBACK_RATIO, LEAST_SAMPLES = 900, 0.25, 3


@query("agg12_render_estimate", _with(CHAPTERS_SQL) + """,
s AS (SELECT series, count(*) FILTER (unlocked AND status NOT IN ('skipped', 'rendered')) AS n_out, median(duration_s) FILTER (status = 'rendered') AS med,
  count(*) FILTER (status = 'rendered' AND source_id % 3 = 0) AS timed, median((30 + source_id % 97) / duration_s) FILTER (status = 'rendered' AND source_id % 3 = 0) AS ratio FROM chapters GROUP BY series),
e AS (SELECT series, n_out, round(n_out * coalesce(med, 900) * CASE WHEN timed >= 3 THEN ratio ELSE 0.25 END, 3) AS wall_s FROM s)
SELECT * FROM e UNION ALL SELECT NULL, sum(n_out)::BIGINT, sum(round(wall_s * 1000)::BIGINT) / 1000.0::DOUBLE FROM e""")
def render_estimate(spark, d):
    """Outstanding chapters x median length x median wall/audio ratio of timed renders, with fallbacks below three samples; a last row with the totals."""
    timed = (F.col("status") == "rendered") & (F.col("source_id") % 3 == 0)
    ratio = (30 + F.col("source_id") % 97) / F.col("duration_s")  # seconds that a render took
    s = chapters(spark, d).groupBy("series").agg(
        F.count_if(F.col("unlocked") & ~F.col("status").isin("skipped", "rendered")).alias("n_out"), F.median(F.when(F.col("status") == "rendered", F.col("duration_s"))).alias("med"),
        F.count_if(timed).alias("timed"), F.median(F.when(timed, ratio)).alias("ratio"),
    )
    rate = F.when(F.col("timed") >= LEAST_SAMPLES, F.col("ratio")).otherwise(F.lit(FALLBACK_RATIO))
    e = s.select("series", "n_out", F.round(F.col("n_out") * F.coalesce("med", F.lit(float(FALLBACK_SECONDS))) * rate, 3).alias("wall_s"))
    total = e.agg(F.sum("n_out").alias("n_out"), (F.sum(F.round(F.col("wall_s") * 1000).cast("bigint")) / 1000).alias("wall_s"))
    return e.unionByName(total.select(F.lit(None).cast("bigint").alias("series"), "n_out", "wall_s"))


def _ticks():
    """Durations as whole ten-thousandths, so that sums do not depend on their order."""
    return F.round(F.col("duration_s") * 10000).cast("bigint")


@query("agg17_resynthesis_cost", _with(CHAPTERS_SQL) + "SELECT series, sum(round(duration_s * 10000)::BIGINT)::BIGINT / 40000.0::DOUBLE AS wall_s, count(*) AS n FROM chapters WHERE status = 'rendered' GROUP BY series")
def resynthesis_cost(spark, d):
    return chapters(spark, d).where("status = 'rendered'").groupBy("series").agg((F.sum(_ticks()) / (10000 / FALLBACK_RATIO)).alias("wall_s"), F.count("*").alias("n"))


@query("agg16_mixed_generations", _with(CHAPTERS_SQL) + "SELECT series, count(DISTINCT volume) AS n_generations, count(*) AS n FROM chapters WHERE status = 'rendered' GROUP BY series HAVING count(DISTINCT volume) > 1")
def mixed_generations(spark, d):
    """Series whose rendered chapters span more than one fingerprint (here: the order's priority)."""
    g = chapters(spark, d).where("status = 'rendered'").groupBy("series").agg(F.count_distinct("volume").alias("n_generations"), F.count("*").alias("n"))
    return g.where("n_generations > 1")


def live_keys(ch: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys that a rendered chapter uses in the current generation."""
    return cache.join(ch.where("status = 'rendered'").select("source_id", "series"), "source_id").where("generation = 'F'").select("series", "key").distinct()


LIVE_SQL = "live AS (SELECT DISTINCT c.series, k.key FROM cache k JOIN chapters c ON c.source_id = k.source_id WHERE c.status = 'rendered' AND k.generation = 'F'), owned AS (SELECT c.series, k.* FROM cache k JOIN chapters c ON c.source_id = k.source_id)"


@query("joi11_cache_reachability", _with(CHAPTERS_SQL, CACHE_SQL, LIVE_SQL) + "SELECT o.series, o.key, o.line, o.source_id, l.key IS NOT NULL AS reachable FROM owned o LEFT JOIN live l ON l.series = o.series AND l.key = o.key")
def cache_reachability(spark, d):
    ch, cache = chapters(spark, d), cache_entries(spark, d)
    owned = cache.join(ch.select("source_id", "series"), "source_id")
    live = live_keys(ch, cache).withColumn("reachable", F.lit(True))
    return owned.join(live, ["series", "key"], "left").select("series", "key", "line", "source_id", F.coalesce("reachable", F.lit(False)).alias("reachable"))


@query("joi12_prune_set", _with(CHAPTERS_SQL, CACHE_SQL, LIVE_SQL) + "SELECT o.series, o.source_id, o.line, CASE WHEN o.generation <> 'F' THEN 'stale' ELSE 'unreachable' END AS why FROM owned o ANTI JOIN live l ON l.series = o.series AND l.key = o.key")
def prune_set(spark, d):
    ch, cache = chapters(spark, d), cache_entries(spark, d)
    owned = cache.join(ch.select("source_id", "series"), "source_id")
    why = F.when(F.col("generation") != "F", "stale").otherwise("unreachable")
    return owned.join(live_keys(ch, cache), ["series", "key"], "left_anti").select("series", "source_id", "line", why.alias("why"))


@query("joi13_reclaim", _with(CHAPTERS_SQL, CACHE_SQL, LIVE_SQL) + """,
held AS (SELECT key, series, bool_or(generation = 'F') AS has_copy FROM owned GROUP BY key, series) SELECT key, count(*) AS n_owners, bool_and(has_copy) AS removable FROM held GROUP BY key""")
def reclaim(spark, d):
    """A shared entry may go only if every owner holds a copy (an entry of that key in its current generation)."""
    ch, cache = chapters(spark, d), cache_entries(spark, d)
    held = cache.join(ch.select("source_id", "series"), "source_id").groupBy("key", "series").agg(F.bool_or(F.col("generation") == "F").alias("has_copy"))
    return held.groupBy("key").agg(F.count("*").alias("n_owners"), F.every("has_copy").alias("removable"))


@query("agg14_cache_status", _with(CHAPTERS_SQL, CACHE_SQL, LIVE_SQL) + """,
m AS (SELECT o.series, o.generation, o.backend, round(o.bytes * 100)::BIGINT AS cents, l.key IS NULL AS loose FROM owned o LEFT JOIN live l ON l.series = o.series AND l.key = o.key)
SELECT series, generation, backend, count(*) AS files, sum(cents)::BIGINT AS cents, coalesce(sum(cents) FILTER (loose), 0)::BIGINT AS reclaimable, sum(cents)::BIGINT // count(*) AS mean_cents
FROM m GROUP BY GROUPING SETS ((series), (generation, backend), (generation), (backend), ())""")
def cache_status(spark, d):
    """Files, bytes (in hundredths), what could go and the mean size: for each series, generation, format and in all."""
    ch, cache = chapters(spark, d), cache_entries(spark, d)
    live = live_keys(ch, cache).withColumn("live", F.lit(True))
    m = cache.join(ch.select("source_id", "series"), "source_id").join(live, ["series", "key"], "left").select("series", "generation", "backend", F.round(F.col("bytes") * 100).cast("bigint").alias("cents"), F.col("live").isNull().alias("loose"))
    sets = m.groupingSets([["series"], ["generation", "backend"], ["generation"], ["backend"], []], "series", "generation", "backend")
    loose = F.coalesce(F.sum(F.when(F.col("loose"), F.col("cents"))), F.lit(0)).cast("bigint")
    return sets.agg(F.count("*").alias("files"), F.sum("cents").alias("cents"), loose.alias("reclaimable"), F.expr("sum(cents) div count(*)").alias("mean_cents"))


@query("agg15_prune_guard", _with(CHAPTERS_SQL, CACHE_SQL, LIVE_SQL) + """,
now AS (SELECT o.series, count(*) AS files, count(l.key) AS live_here FROM owned o LEFT JOIN live l ON l.series = o.series AND l.key = o.key GROUP BY o.series),
last AS (SELECT series, count(*) AS live_then FROM owned WHERE generation = 'F' AND backend <> 'A' GROUP BY series)
SELECT now.series, files, live_here, live_then, CASE WHEN live_here = 0 THEN 'nothing reachable' WHEN 10 * live_here < 8 * live_then THEN 'reachable fell' ELSE 'ok' END AS verdict FROM now LEFT JOIN last ON last.series = now.series""")
def prune_guard(spark, d):
    """Refuses when nothing is reachable, or reachable fell by over a fifth since the last run. The last run's table has the entries of the current
    generation that were not yet written in the newest format."""
    ch, cache = chapters(spark, d), cache_entries(spark, d)
    r = cache_reachability(spark, d).groupBy("series").agg(F.count("*").alias("files"), F.count_if("reachable").alias("live_here"))
    last = cache.where("generation = 'F' AND backend <> 'A'").join(ch.select("source_id", "series"), "source_id").groupBy("series").agg(F.count("*").alias("live_then"))
    verdict = F.when(F.col("live_here") == 0, "nothing reachable").when(10 * F.col("live_here") < 8 * F.col("live_then"), "reachable fell").otherwise("ok")
    return r.join(last, "series", "left").select("series", "files", "live_here", "live_then", verdict.alias("verdict"))


@query("agg20_size_breakdown", _with(CACHE_SQL) + """
SELECT backend AS part, count(*) AS files, round(sum(bytes), 2) AS bytes, row_number() OVER (ORDER BY sum(bytes) DESC) AS place
FROM (SELECT backend, key, max(bytes) AS bytes FROM cache GROUP BY backend, key) GROUP BY backend""")
def size_breakdown(spark, d):
    """Each inode (key) counts once in a part; largest part first."""
    once = cache_entries(spark, d).groupBy("backend", "key").agg(F.max("bytes").alias("bytes"))
    by = once.groupBy(F.col("backend").alias("part")).agg(F.count("*").alias("files"), F.sum("bytes").alias("b"))
    return by.select("part", "files", F.round("b", 2).alias("bytes"), F.row_number().over(Window.orderBy(F.col("b").desc())).alias("place"))


# --- windows and orders


@query("win1_volume_position", _with(CHAPTERS_SQL) + "SELECT series, source_id, CASE WHEN volume NOT LIKE '5%' THEN row_number() OVER (PARTITION BY series, volume ORDER BY ord) END AS place FROM chapters")
def volume_position(spark, d):
    place = F.row_number().over(Window.partitionBy("series", "volume").orderBy("ord"))
    return chapters(spark, d).select("series", "source_id", F.when(~F.col("volume").startswith("5"), place).alias("place"))


@query("win3_feed_dates", _with(CHAPTERS_SQL) + """,
s AS (SELECT series, source_id, ord, published + INTERVAL 1 DAY * ((source_id % 5) * 40) AS stamp FROM chapters)
SELECT series, source_id, min(stamp) OVER (PARTITION BY series ORDER BY ord DESC ROWS UNBOUNDED PRECEDING) AS feed_date FROM s""")
def feed_dates(spark, d):
    """A date is capped at the earliest date of any later item."""
    stamp = F.expr("published + make_dt_interval(int((source_id % 5) * 40))")
    later = Window.partitionBy("series").orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return chapters(spark, d).select("series", "source_id", F.min(stamp).over(later).alias("feed_date"))


@query("win4_feed_items", _with(CHAPTERS_SQL) + """,
v AS (SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY volume) AS season FROM chapters)
SELECT series, source_id, season, row_number() OVER (PARTITION BY series, volume ORDER BY ord) AS episode,
  'Season ' || season || ' · Chapter ' || n || CASE WHEN duration_s >= 60 THEN ' · ' || floor(duration_s / 60)::INT || ' min' ELSE '' END AS notes FROM v""")
def feed_items(spark, d):
    """SNK4 / WIN4: season, episode and notes of each item; missing parts are left out of the notes."""
    season = F.dense_rank().over(Window.partitionBy("series").orderBy("volume"))
    ep = F.row_number().over(Window.partitionBy("series", "volume").orderBy("ord"))
    v = chapters(spark, d).select("*", season.alias("season"), ep.alias("episode"))
    minutes = F.when(F.col("duration_s") >= 60, F.concat(F.floor(F.col("duration_s") / 60).cast("string"), F.lit(" min")))
    notes = F.concat_ws(" · ", F.concat(F.lit("Season "), F.col("season").cast("string")), F.concat(F.lit("Chapter "), F.col("n").cast("string")), minutes)
    return v.select("series", "source_id", "season", "episode", notes.alias("notes"))


@query("win13_timeline", _with(CHAPTERS_SQL) + "SELECT series, source_id, coalesce(sum(round(duration_s * 10000)::BIGINT) OVER (PARTITION BY series ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT / 10000.0::DOUBLE AS start_s FROM chapters")
def timeline(spark, d):
    before = Window.partitionBy("series").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return chapters(spark, d).select("series", "source_id", (F.coalesce(F.sum(_ticks()).over(before), F.lit(0)) / 10000).alias("start_s"))


@query("win17_neighbours", _with(CHAPTERS_SQL) + "SELECT series, source_id, lag(source_id) OVER w AS prev_id, lead(source_id) OVER w AS next_id FROM chapters WINDOW w AS (PARTITION BY series ORDER BY ord)")
def neighbours(spark, d):
    w = Window.partitionBy("series").orderBy("ord")
    return chapters(spark, d).select("series", "source_id", F.lag("source_id").over(w).alias("prev_id"), F.lead("source_id").over(w).alias("next_id"))


@query("srt1_library_order", _with(SERIES_SQL) + "SELECT series, row_number() OVER (ORDER BY enabled DESC, coalesce(priority, 100) DESC, title) AS place FROM series")
def library_order(spark, d):
    """Enabled first, then priority, then title. Places are counted within steps of priority, and the rows before a step are added: only the
    steps' counts, as many as there are whole priorities, go through one task."""
    s = series(spark, d).select("series", "title", F.col("enabled").cast("int").alias("e"), F.coalesce("priority", F.lit(100.0)).alias("p")).withColumn("step", F.floor("p"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.col("e").desc(), F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = s.groupBy("e", "step").agg(F.count("*").alias("n")).select("e", "step", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("e", "step").orderBy(F.col("p").desc(), "title"))
    return s.select("series", "e", "step", within.alias("k")).join(steps, ["e", "step"]).select("series", (F.col("before") + F.col("k")).alias("place"))


@query("srt2_first_outstanding", _with(CHAPTERS_SQL, OUT_SQL) + "SELECT series, source_id, n FROM out QUALIFY row_number() OVER (PARTITION BY series ORDER BY ord) <= 3")
def first_outstanding(spark, d):
    w = Window.partitionBy("series").orderBy("ord")
    return outstanding_rows(chapters(spark, d)).withColumn("r", F.row_number().over(w)).where("r <= 3").select("series", "source_id", "n")


@query("srt5_title_order", _with(SERIES_SQL) + "SELECT series, lower(title) AS sort_title, row_number() OVER (PARTITION BY provider ORDER BY lower(title), series) AS place FROM series")
def title_order(spark, d):
    """Titles in order without regard to case, within each provider."""
    rows = series(spark, d).select("series", F.lower("title").alias("sort_title"), "provider")
    return placed(rows, "provider", [F.asc("sort_title"), F.asc("series")]).select("series", "sort_title", "place")


@query("sel8_feed_order", _with(CHAPTERS_SQL) + "SELECT series, string_agg(source_id::VARCHAR, ',' ORDER BY ord DESC) AS newest_first FROM chapters WHERE status = 'rendered' GROUP BY series")
def feed_order(spark, d):
    items = F.reverse(F.array_sort(F.collect_list(F.struct("ord", "source_id"))))
    return chapters(spark, d).where("status = 'rendered'").groupBy("series").agg(F.array_join(F.transform(items, lambda x: x["source_id"].cast("string")), ",").alias("newest_first"))


@query("snk3_state_export", _with(CHAPTERS_SQL) + """, v AS (SELECT series, to_json(list(volume ORDER BY volume)) AS volumes FROM (SELECT DISTINCT series, volume FROM chapters WHERE volume NOT LIKE '5%') GROUP BY series),
c AS (SELECT series, list({'ord': ord, 'source_id': source_id, 'status': status, 'volume': volume, 'audio': CASE WHEN status = 'rendered' THEN 'audio/' || source_id || '.opus' END} ORDER BY ord) AS cs FROM chapters GROUP BY series)
SELECT c.series, '{"schema":3,"volumes":' || coalesce(v.volumes::VARCHAR, '[]') || ',"chapters":' || to_json(cs)::VARCHAR || '}' AS state FROM c LEFT JOIN v ON v.series = c.series""")
def state_export(spark, d):
    """One JSON document a series with its volumes and chapters in order; paths are relative to the series' folder."""
    path = F.concat(F.lit("/library/"), F.col("series").cast("string"), F.lit("/audio/"), F.col("source_id").cast("string"), F.lit(".opus"))
    audio = F.when(F.col("status") == "rendered", F.expr("replace(path, concat('/library/', series, '/'), '')")).alias("audio")
    c = chapters(spark, d).withColumn("path", path)
    item = F.struct("ord", "source_id", "status", "volume", audio)
    volumes = F.array_sort(F.collect_set(F.when(~F.col("volume").startswith("5"), F.col("volume"))))
    whole = F.struct(F.lit(3).alias("schema"), volumes.alias("volumes"), F.array_sort(F.collect_list(item)).alias("chapters"))
    return c.groupBy("series").agg(F.to_json(whole, {"ignoreNullFields": "false"}).alias("state"))


@query("str27_tag_map", _with(CHAPTERS_SQL) + """
SELECT series, source_id, 'album=Series ' || series || ';' || CASE WHEN volume LIKE '5%' THEN '' ELSE 'disc=' || volume || ';' END || 'title=Chapter ' || n || ';track=' || n AS tags FROM chapters""")
def tag_map(spark, d):
    """Tags of a chapter: later sources override, empty ones are dropped."""
    base = F.create_map(F.lit("album"), F.concat(F.lit("Series "), F.col("series").cast("string")), F.lit("title"), F.lit(""), F.lit("disc"), F.lit(""))
    own = F.create_map(F.lit("title"), F.concat(F.lit("Chapter "), F.col("n").cast("string")), F.lit("track"), F.col("n").cast("string"), F.lit("disc"), F.when(F.col("volume").startswith("5"), "").otherwise(F.col("volume")))
    over = F.map_zip_with(base, own, lambda k, a, b: F.coalesce(b, a))
    kept = F.array_sort(F.map_entries(F.map_filter(over, lambda k, v: v != "")))
    return chapters(spark, d).select("series", "source_id", F.array_join(F.transform(kept, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("tags"))


@query("dat3_formats", _with(CHAPTERS_SQL) + """, t AS (SELECT *, floor(duration_s)::INT AS s, floor(duration_s * duration_s * 40)::BIGINT AS size FROM chapters)
SELECT source_id, strftime(published, '%a, %d %b %Y %H:%M:%S +0000') AS rfc822, s // 3600 || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS hms, s // 60 || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS player,
  CASE WHEN s < 90 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' ELSE s // 3600 || 'h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' END AS human,
  CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0) WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0) ELSE printf('%.1f GB', size / 1073741824.0) END AS bytes FROM t""")
def formats(spark, d):
    """RFC 822 date, h:mm:ss, player time, a duration and a size for people."""
    t, size = F.floor("duration_s").cast("int"), F.floor(F.col("duration_s") * F.col("duration_s") * 40).cast("bigint")
    c = chapters(spark, d).select("source_id", "published", t.alias("s"), size.alias("size"))
    minutes, hours = F.expr("s % 3600 div 60"), F.expr("s div 3600")
    human = F.when(F.col("s") < 90, F.format_string("%ds", "s")).when(F.col("s") < 3600, F.format_string("%dm", F.expr("s div 60"))).otherwise(F.format_string("%dh %02dm", hours, minutes))
    in_units = F.format_string("%d B", "size")
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        in_units = F.when(F.col("size") >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(F.col("size") / 1024.0**power, 1))).otherwise(in_units)
    return c.select(
        "source_id", F.date_format("published", "EEE, dd MMM yyyy HH:mm:ss '+0000'").alias("rfc822"), F.format_string("%d:%02d:%02d", hours, minutes, F.expr("s % 60")).alias("hms"),
        F.format_string("%d:%02d", F.expr("s div 60"), F.expr("s % 60")).alias("player"), human.alias("human"), in_units.alias("bytes"),
    )


@query("dat1_date_parse", _with(CHAPTERS_SQL) + "SELECT source_id, date_trunc('second', published) AS parsed FROM chapters")
def date_parse(spark, d):
    """ISO variants of one moment parse alike; fractions are dropped, a missing zone is UTC."""
    kind = F.col("source_id") % 3
    text = F.when(kind == 0, F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 1, F.date_format("published", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
    plain = F.regexp_replace(F.regexp_replace(text, r"\.[0-9]+", ""), r"(Z|\+00:00)$", "")
    parsed = F.coalesce(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")))
    return chapters(spark, d).select("source_id", parsed.cast("timestamp_ntz").alias("parsed"))


@query("snk4_feed", _with(CHAPTERS_SQL, SERIES_SQL) + """,
v AS (SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY volume) AS season, row_number() OVER (PARTITION BY series, volume ORDER BY ord) AS episode, published + INTERVAL 1 DAY * ((source_id % 5) * 40) AS stamp FROM chapters),
r AS (SELECT *, min(stamp) OVER (PARTITION BY series ORDER BY ord DESC ROWS UNBOUNDED PRECEDING) AS feed_date FROM v WHERE status = 'rendered'),
f AS (SELECT r.*, s.slug, s.title, '/audio/' || s.slug || '/' || r.source_id || CASE WHEN r.source_id % 3 = 0 THEN '.mp3' WHEN r.source_id % 3 = 1 THEN '.opus' ELSE '.bin' END AS url FROM r JOIN series s ON s.series = r.series)
SELECT series, 'item' AS kind, 'sm-' || source_id AS guid, 'Chapter ' || n AS title, feed_date, CASE WHEN volume NOT LIKE '5%' THEN season END AS season, CASE WHEN volume NOT LIKE '5%' THEN episode ELSE n END AS episode, url,
  round(duration_s * 4000)::BIGINT AS length, CASE WHEN url LIKE '%.mp3' THEN 'audio/mpeg' WHEN url LIKE '%.opus' THEN 'audio/ogg' ELSE 'application/octet-stream' END AS type FROM f
UNION ALL SELECT series, 'channel', 'sm', any_value(title), max(feed_date), NULL, count(*), '/feed/' || any_value(slug) || '.xml', NULL, 'application/rss+xml' FROM f GROUP BY series""")
def feed(spark, d):
    """SNK4: the feed of each series: an item for each rendered chapter, with a guid that never changes, a capped date, its place in the volume and its
    enclosure; and one channel row."""
    v = chapters(spark, d).select(
        "*", F.dense_rank().over(Window.partitionBy("series").orderBy("volume")).alias("season"), F.row_number().over(Window.partitionBy("series", "volume").orderBy("ord")).alias("episode"),
        F.expr("published + make_dt_interval(int((source_id % 5) * 40))").alias("stamp"),
    ).where("status = 'rendered'")
    later = Window.partitionBy("series").orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, 0)
    k = F.col("source_id") % 3
    name = F.concat(F.lit("/audio/"), "slug", F.lit("/"), F.col("source_id").cast("string"), F.when(k == 0, ".mp3").when(k == 1, ".opus").otherwise(".bin"))
    f = v.withColumn("feed_date", F.min("stamp").over(later)).join(series(spark, d).select("series", "slug", F.col("title").alias("name")), "series").withColumn("url", name)
    known = F.create_map(*[F.lit(x) for x in ("mp3", "audio/mpeg", "opus", "audio/ogg")])
    mime = F.coalesce(F.element_at(known, F.substring_index("url", ".", -1)), F.lit("application/octet-stream"))
    placed = ~F.col("volume").startswith("5")
    items = f.select(
        "series", F.lit("item").alias("kind"), F.concat(F.lit("sm-"), F.col("source_id").cast("string")).alias("guid"), F.concat(F.lit("Chapter "), F.col("n").cast("string")).alias("title"), "feed_date",
        F.when(placed, F.col("season")).alias("season"), F.when(placed, F.col("episode")).otherwise(F.col("n")).cast("bigint").alias("episode"), "url", F.round(F.col("duration_s") * 4000).cast("bigint").alias("length"), mime.alias("type"),
    )
    heads = f.groupBy("series").agg(F.any_value("name").alias("title"), F.max("feed_date").alias("feed_date"), F.count("*").alias("episode"), F.any_value("slug").alias("slug"))
    channel = heads.select(
        "series", F.lit("channel").alias("kind"), F.lit("sm").alias("guid"), "title", "feed_date", F.lit(None).cast("int").alias("season"), "episode", F.concat(F.lit("/feed/"), "slug", F.lit(".xml")).alias("url"),
        F.lit(None).cast("bigint").alias("length"), F.lit("application/rss+xml").alias("type"),
    )
    return items.unionByName(channel)


@query("src3_rules", """SELECT p_type AS surface, CASE p_partkey % 3 WHEN 0 THEN 'VBD' WHEN 1 THEN 'NOUN' ELSE '' END AS pos, CASE p_partkey % 3 WHEN 0 THEN lower(p_brand) ELSE '' END AS lemma, p_name AS respell, '' AS notes FROM part""")
def rules_from_csv(spark, d):
    """SRC3: rule rows out of CSV lines; a tag with a lemma is split."""
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 3
    line = F.to_csv(F.struct("p_type", F.when(k == 0, F.concat(F.lit("VBD+"), F.lower("p_brand"))).when(k == 1, "NOUN").alias("pos"), "p_name", F.lit(None).cast("string").alias("notes")))
    return files.rule_rows(p.select(F.from_csv(line, F.lit(files.RULES)).alias("r")).select("r.*"))


@query("src4_embedded_chapters", _with(CHAPTERS_SQL) + "SELECT series, source_id::VARCHAR AS id, 'Chapter ' || n AS title, ord::INT AS ord, unlocked FROM chapters WHERE source_id % 13 <> 0")
def chapters_in_pages(spark, d):
    """SRC4: the chapter list that a series page assigns in a script; entries without a numeric id go."""
    c = chapters(spark, d)
    entry = F.struct(F.when(F.col("source_id") % 13 == 0, "n/a").otherwise(F.col("source_id").cast("string")).alias("id"), F.concat(F.lit("Chapter "), F.col("n").cast("string")).alias("title"), F.col("ord").alias("order"), F.col("unlocked").alias("isUnlocked"))
    html = F.concat(F.lit("<script>window.volumes = []; window.chapters = "), F.to_json(F.collect_list(entry)), F.lit("; var x = [1];</script>"))
    rows = c.groupBy("series").agg(html.alias("html")).select("series", F.explode(files.embedded_chapters(F.col("html"))).alias("c"))
    return rows.select("series", "c.id", "c.title", F.col("c.order").alias("ord"), F.col("c.isUnlocked").alias("unlocked"))


@query("src5_toc_rows", _with(CHAPTERS_SQL) + "SELECT series, ord::INT AS ord, source_id::VARCHAR AS id, 'Chapter ' || n AS title, 'chapter-' || n AS slug, date_trunc('minute', published) AS published, ceil(count(*) OVER (PARTITION BY series) / 15.0)::INT AS n_pages FROM chapters")
def toc(spark, d):
    """SRC5: the rows of a table of contents, and how many pages of 15 it has."""
    s = lambda c: F.col(c).cast("string")
    item = F.concat(F.lit('<li class="toc_w" order="'), s("n"), F.lit('"><a class="toc_a" href="/read/'), s("series"), F.lit("/chapter/"), s("source_id"), F.lit('/">Chapter <b>'), s("n"), F.lit('</b></a><span class="fic_date_pub" title="'), F.date_format("published", "MMM d, yyyy hh:mm a"), F.lit('"></span></li>'))
    pages = chapters(spark, d).groupBy("series").agg(F.array_join(F.collect_list(item), "").alias("html"), files.toc_page_count(F.count("*"), 15).alias("n_pages"))
    rows = pages.select("series", "n_pages", F.explode(files.toc_rows(F.col("html"))).alias("t"))
    return rows.select("series", "t.ord", "t.id", "t.title", "t.slug", F.col("t.published").cast("timestamp_ntz").alias("published"), "n_pages")


@query("src7_state_rows", _with(CHAPTERS_SQL) + """SELECT md5(series::VARCHAR) AS uuid, CASE WHEN series % 2 = 0 THEN series::VARCHAR ELSE 'rr' || series END AS source_id, count(*) AS n_chapters, CASE WHEN series % 5 = 0 THEN 'newer schema' END AS problem FROM chapters GROUP BY series""")
def state_documents(spark, d):
    """SRC7: state documents read back; the legacy id is taken over, newer schemas are marked."""
    c = chapters(spark, d).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("source_id").cast("string").alias("source_id"), "status"))).alias("chapters"))
    n, even = F.col("series").cast("string"), F.col("series") % 2 == 0
    doc = F.to_json(F.struct(F.when(F.col("series") % 5 == 0, 9).otherwise(3).alias("schema"), F.md5(n).alias("uuid"), F.when(even, n).alias("source_id"), F.when(~even, F.concat(F.lit("rr"), n)).alias("rr_id"), "chapters"))
    rows = files.state_rows(c.select(F.from_json(doc, files.STATE).alias("s")).select("s.*"))
    return rows.select("uuid", "source_id", F.size("chapters").cast("bigint").alias("n_chapters"), "problem")


@query("stm4_page_ingest", """WITH a AS (SELECT page_id, 0 AS arrival FROM pages UNION ALL SELECT page_id, 1 FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT NULL, 2 FROM pages WHERE page_id % 50 = 0)
SELECT page_id, arrival, CASE WHEN page_id IS NULL THEN 'rejected' WHEN arrival = 0 THEN 'ingested' ELSE 'have' END AS outcome FROM a""")
def page_ingest(spark, d):
    """The batch twin of the page stream: the first arrival of an id is ingested, later ones are already held, pages without an id rejected."""
    p = table(spark, d, "pages").select("page_id")
    a = p.withColumn("arrival", F.lit(0)).unionByName(p.where("page_id % 3 = 0").withColumn("arrival", F.lit(1))).unionByName(p.where("page_id % 50 = 0").select(F.lit(None).cast("bigint").alias("page_id"), F.lit(2).alias("arrival")))
    first = F.row_number().over(Window.partitionBy("page_id").orderBy("arrival")) == 1
    known = a.where("page_id IS NOT NULL").select("page_id", "arrival", F.when(first, "ingested").otherwise("have").alias("outcome"))
    return known.unionByName(a.where("page_id IS NULL").select("page_id", "arrival", F.lit("rejected").alias("outcome")))
