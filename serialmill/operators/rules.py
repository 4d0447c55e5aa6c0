"""Rules and readings: lexicon resolution, layering, normalisation steps, evaluation, incremental work lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from serialmill.functions import hooks, runs, spans
from serialmill.functions import text as T
from serialmill.functions.speakers import FEMALE, MALE
from serialmill.operators import corpus
from serialmill.operators.corpus import NAMES_SQL, PAUSES, SENTENCES_SQL, TOKENS_SQL, names, tokens
from serialmill.operators.listening import positions
from serialmill.operators.registry import registry
from serialmill.sources.bindings import CHAPTERS_SQL, LINES_SQL, PLAYS_SQL, chapters, lines, table

QUERIES, ORACLES, query = registry()

@query("joi23_layering", "SELECT p_type AS surface, arg_max(p_name, (p_brand, p_partkey)) AS respell, count(*) AS n_rules FROM part GROUP BY p_type")
def layering(spark, d):
    """The same surface in several layers (brands): the last layer wins."""
    return table(spark, d, "part").groupBy(F.col("p_type").alias("surface")).agg(F.max_by("p_name", F.struct("p_brand", "p_partkey")).alias("respell"), F.count("*").alias("n_rules"))


@query("joi14_skip_unchanged", "SELECT doc_id, left(sha256(text || CASE WHEN doc_id % 5 = 0 THEN '|48000' ELSE '|24000' END), 32) AS recipe FROM documents WHERE doc_id % 5 = 0 OR doc_id % 11 = 0")
def skip_unchanged(spark, d):
    """Work list: chapters whose new recipe differs from the stored one, or that have no output."""
    docs = table(spark, d, "documents")
    recipe = lambda tail: F.left(F.sha2(F.concat("text", tail), 256), F.lit(32)).alias("recipe")
    stored = docs.where("doc_id % 11 <> 0").select("doc_id", recipe(F.lit("|24000")))
    now = docs.select("doc_id", recipe(F.when(F.col("doc_id") % 5 == 0, "|48000").otherwise("|24000")))
    return now.join(stored, ["doc_id", "recipe"], "left_anti")


@query("joi18_position_rows", f"WITH {PLAYS_SQL}, {CHAPTERS_SQL}, p AS (SELECT profile, arg_max(chapter, (ts, event_id)) AS chapter FROM plays WHERE chapter IS NOT NULL GROUP BY profile) SELECT p.profile, p.chapter, c.source_id, c.status FROM p JOIN chapters c ON c.series = p.profile AND c.ord = p.chapter % 5")
def position_rows(spark, d):
    p = positions(spark, d).select("profile", "chapter", F.col("profile").alias("series"), (F.col("chapter") % 5).alias("ord"))
    return p.join(chapters(spark, d), ["series", "ord"]).select("profile", "chapter", "source_id", "status")


_PRONOUNS = "'" + "', '".join([*MALE, *FEMALE]) + "'"


@query("joi19_name_before_pronoun", f"""WITH {TOKENS_SQL}, n AS (SELECT doc_id, line_no, pos, lower(token) AS w, CASE WHEN regexp_matches(token, '^[A-Z][a-z]+$') THEN token END AS name FROM tokens),
a AS (SELECT *, last_value(name IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS named FROM n)
SELECT named AS name, w AS pronoun, count(*) AS n FROM a WHERE w IN ({_PRONOUNS}) AND named IS NOT NULL GROUP BY named, w""")
def name_before_pronoun(spark, d):
    """As-of: the latest name before each pronoun of a chapter."""
    w = Window.partitionBy("doc_id").orderBy("line_no", "pos").rowsBetween(Window.unboundedPreceding, -1)
    t = tokens(spark, d).select("doc_id", "line_no", "pos", F.lower("token").alias("w"), F.when(F.col("token").rlike("^[A-Z][a-z]+$"), F.col("token")).alias("name"))
    t = t.where(F.col("name").isNotNull() | F.col("w").isin(*MALE, *FEMALE))  # only these rows are sorted
    a = t.withColumn("named", F.last("name", ignorenulls=True).over(w)).where(F.col("w").isin(*MALE, *FEMALE) & F.col("named").isNotNull())
    return a.groupBy(F.col("named").alias("name"), F.col("w").alias("pronoun")).agg(F.count("*").alias("n"))


@query("agg4_gender_guess", f"""WITH {TOKENS_SQL} SELECT prev AS name, arg_max(CASE WHEN lower(token) IN ({", ".join(f"'{w}'" for w in MALE)}) THEN 'm' ELSE 'f' END, (doc_id, line_no, pos)) AS gender, count(*) AS evidence
FROM tokens WHERE lower(token) IN ({_PRONOUNS}) AND regexp_matches(prev, '^[A-Z][a-z]+$') GROUP BY prev""")
def gender_guess(spark, d):
    """The last evidence (a pronoun right after the name) wins; the fold of speakers looks further."""
    e = tokens(spark, d).where(F.lower("token").isin(*MALE, *FEMALE) & F.col("prev").rlike("^[A-Z][a-z]+$"))
    g = F.max_by(F.when(F.lower("token").isin(*MALE), "m").otherwise("f"), F.struct("doc_id", "line_no", "pos"))
    return e.groupBy(F.col("prev").alias("name")).agg(g.alias("gender"), F.count("*").alias("evidence"))


@query("agg8_inconsistent_readings", "SELECT d.source, d.lang, count(DISTINCT l.quality) AS n_readings, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source, d.lang HAVING count(DISTINCT l.quality) > 1")
def inconsistent_readings(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    return j.groupBy("source", "lang").agg(F.count_distinct("quality").alias("n_readings"), F.count("*").alias("n")).where("n_readings > 1")


@query("agg23_lead_from_tags", "SELECT p_brand AS series, bool_or(contains(lower(p_type), 'steel')) AND NOT bool_or(contains(lower(p_type), 'brass')) AS female_lead, count(DISTINCT p_type) AS n_tags FROM part GROUP BY p_brand")
def lead_from_tags(spark, d):
    """Tagged for one lead and not for the other."""
    has = lambda w: F.bool_or(F.contains(F.lower("p_type"), F.lit(w)))
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("series")).agg((has("steel") & ~has("brass")).alias("female_lead"), F.count_distinct("p_type").alias("n_tags"))


# --- normalisation steps


@query("str15_system_clauses", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]{2,}', ' ', 'g'), ' ' || chr(9))), lambda x: x <> '') AS ls FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, len(ls) + 1), lambda i: ls[i] || CASE WHEN i = len(ls) THEN '' WHEN ends_with(ls[i], ':') THEN ' ' ELSE '. ' END), '') AS body FROM l WHERE len(ls) > 0""")
def system_clauses(spark, d):
    """Lines of a box become clauses; a header line that ends with a colon is bound to the next, and the last line is left as it is."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]{2,}", " "), r"^[ \t]+|[ \t]+$", "")
    ls = F.filter(F.transform(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1), clean), lambda x: x != "")
    joined = lambda a: F.array_join(F.transform(a, lambda x, i: F.concat(x, F.when(i == F.size(a) - 1, "").when(x.endswith(":"), " ").otherwise(". "))), "")
    return table(spark, d, "documents").select("doc_id", ls.alias("ls")).where(F.size("ls") > 0).select("doc_id", joined(F.col("ls")).alias("body"))


@query("str2_paragraphs", r"""WITH p AS (SELECT doc_id, string_split_regex(text, '\n[ \t]*\n') AS ps, list_transform(regexp_extract_all(text, '\n[ \t]*\n'), lambda x: length(x)) AS gaps FROM documents), i AS (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM p)
SELECT doc_id, (list_sum(list_prepend(0, list_transform(ps[:i - 1], lambda x: length(x)))) + list_sum(list_prepend(0, gaps[:i - 1])))::INT AS start, ps[i] AS body FROM i WHERE trim(ps[i], ' ' || chr(9) || chr(10)) <> ''""")
def paragraphs(spark, d):
    """Paragraphs at blank lines, with their places in the chapter, so that spans can be re-based."""
    bits = F.split(F.regexp_replace("text", r"(\n[ \t]*\n)", "\u0001$1\u0001"), "\u0001", -1)  # text and gaps in turn
    docs = table(spark, d, "documents").select("doc_id", bits.alias("bits")).select("doc_id", "bits", F.posexplode("bits").alias("i", "body"))
    start = F.aggregate(F.slice("bits", F.lit(1), F.col("i")), F.lit(0), lambda n, x: n + F.length(x))
    return docs.where((F.col("i") % 2 == 0) & F.col("body").rlike(r"[^ \t\n]")).select("doc_id", start.alias("start"), "body")


@query("str20_match_case", f"""WITH {TOKENS_SQL}, {NAMES_SQL} SELECT word, upper(left(reverse(lower(word)), 1)) || substr(reverse(lower(word)), 2) AS respell, count(*) AS n FROM names GROUP BY word""")
def match_case(spark, d):
    """A respelling takes over a leading capital, and only that (here every name is respelled backwards)."""
    low = F.reverse(F.lower("word"))
    said = F.when(F.col("word").rlike(r"^\p{Lu}"), F.concat(F.upper(F.left(low, F.lit(1))), F.expr("substring(reverse(lower(word)), 2)"))).otherwise(low)
    return names(spark, d).groupBy("word", said.alias("respell")).agg(F.count("*").alias("n"))


@query("str20_trimmed_edges", rf"""WITH {LINES_SQL}, t AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '\S+')) AS token FROM lines)
SELECT regexp_replace(token, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g') AS word, length(regexp_extract(token, '^[^\p{{L}}\p{{N}}_]*')) AS moved, count(*) AS n FROM t WHERE regexp_matches(token, '[\p{{L}}\p{{N}}_]') GROUP BY 1, 2""")
def trimmed_edges(spark, d):
    """Punctuation at a token's edges is no part of the word; the word's place moves by what is cut before it."""
    t = lines(spark, d).select(F.explode(F.regexp_extract_all("line", F.lit(r"\S+"), F.lit(0))).alias("token")).where(F.col("token").rlike(r"[\p{L}\p{N}_]"))
    word = F.regexp_replace("token", r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    moved = F.length(F.regexp_extract("token", r"^[^\p{L}\p{N}_]*", 0)).cast("bigint")
    return t.groupBy(word.alias("word"), moved.alias("moved")).agg(F.count("*").alias("n"))


@query("dat2_site_dates", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('day', ts) ELSE TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 1 HOUR * (event_id % 50) END AS published FROM events")
def site_dates(spark, d, now: str = "2024-02-01 00:00:00"):
    """Absolute dates, or "N hours ago" against a given now."""
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "MMM d, yyyy")).otherwise(F.concat((F.col("event_id") % 50).cast("string"), F.lit(" hours ago")))
    hours = F.expr("try_cast(nullif(regexp_extract(said, '^([0-9]+) hours? ago', 1), '') AS INT)")
    e = table(spark, d, "events").select("event_id", text.alias("said"))
    when = F.coalesce(F.try_to_timestamp("said", F.lit("MMM d, yyyy")), F.lit(now).cast("timestamp") - F.make_interval(hours=hours))
    return e.select("event_id", when.cast("timestamp_ntz").alias("published"))


@query("hsh3_fingerprints", "SELECT s_suppkey, left(sha256('balance=' || s_acctbal::DECIMAL(12,2) || ',lang=en,name=' || s_name || ',rate=24000'), 12) AS fingerprint FROM supplier")
def fingerprints(spark, d):
    """Sorted key=value pairs, hashed."""
    m = F.create_map(F.lit("rate"), F.lit("24000"), F.lit("name"), F.col("s_name"), F.lit("lang"), F.lit("en"), F.lit("balance"), F.col("s_acctbal").cast("decimal(12,2)").cast("string"))
    pairs = F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return table(spark, d, "supplier").select("s_suppkey", F.left(F.sha2(F.array_join(pairs, ","), 256), F.lit(12)).alias("fingerprint"))


@query("snk1_segment_json", f"""WITH {SENTENCES_SQL}, g AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, sent_no) - 1 AS seg_no, sentence, lead(sent_no) OVER (PARTITION BY doc_id, line_no ORDER BY sent_no) IS NULL AS para_end FROM sentences)
SELECT doc_id, to_json(list({{'seg_no': seg_no::INT, 'kind': CASE WHEN regexp_matches(sentence, '[\\p{{L}}\\p{{N}}]') THEN 'speech' ELSE 'pause' END, 'text': sentence, 'style': CASE WHEN starts_with(sentence, '"') THEN 'dialogue' ELSE 'narration' END,
  'voice': CASE WHEN starts_with(sentence, '"') THEN 'dialogue' ELSE 'narrator' END, 'pause_ms': (CASE WHEN para_end THEN {PAUSES["paragraph"]} ELSE {PAUSES["sentence"]} END)::INT}} ORDER BY seg_no))::VARCHAR AS segments FROM g GROUP BY doc_id""")
def segment_json(spark, d):
    """One ordered list of segments for each chapter, as JSON, built on the chapter's own row."""
    quoted = lambda s, a, b: F.when(s.startswith('"'), a).otherwise(b)
    ended = lambda s: F.transform(s, lambda x, i: F.struct(x.alias("text"), (i == F.size(s) - 1).alias("end")))
    whole = F.flatten(F.transform(F.split("text", "\n", -1), lambda x: T.bound(T.sentences(x), ended)))
    item = lambda x, i: F.struct(
        i.alias("seg_no"), F.when(x["text"].rlike(r"[\p{L}\p{N}]"), "speech").otherwise("pause").alias("kind"), x["text"].alias("text"), quoted(x["text"], "dialogue", "narration").alias("style"),
        quoted(x["text"], "dialogue", "narrator").alias("voice"), F.when(x["end"], PAUSES["paragraph"]).otherwise(PAUSES["sentence"]).alias("pause_ms"),
    )
    docs = table(spark, d, "documents").select("doc_id", whole.alias("s")).where(F.size("s") > 0)
    return docs.select("doc_id", F.to_json(F.transform("s", item)).alias("segments"))


@query("snk6_proposed_rules", f"SELECT word AS surface, '' AS pos, left_part || '-' || right_part AS respell, 'used ' || n || ' in ' || labels AS notes FROM ({corpus.ORACLES['agg7_compounds']})")
def proposed_rules(spark, d):
    """Rows of a rule file for flagged compounds, ready for ``write.csv``."""
    notes = F.concat(F.lit("used "), F.col("n").cast("string"), F.lit(" in "), "labels")
    return corpus.compounds(spark, d).select(F.col("word").alias("surface"), F.lit("").alias("pos"), F.concat_ws("-", "left_part", "right_part").alias("respell"), notes.alias("notes"))


@query("joi22_config_overlay", """SELECT c_custkey AS series, CASE WHEN c_custkey % 3 = 0 THEN 0.9 ELSE 1.0 END::DOUBLE AS rate, CASE WHEN c_custkey % 5 = 0 THEN 'de' ELSE 'en' END AS lang,
  'narrator=' || CASE WHEN c_custkey % 3 = 0 THEN 'warm' ELSE 'plain' END || CASE WHEN c_custkey % 3 = 0 THEN ',thought=soft' ELSE '' END AS effects FROM customer""")
def config_overlay(spark, d):
    """A series' own settings change only the keys they name; effect maps merge key by key."""
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("series"))
    own = s.where("series % 3 = 0 OR series % 5 = 0").select(
        "series", F.when(F.col("series") % 3 == 0, 0.9).alias("o_rate"), F.when(F.col("series") % 5 == 0, "de").alias("o_lang"),
        F.when(F.col("series") % 3 == 0, F.create_map(F.lit("narrator"), F.lit("warm"), F.lit("thought"), F.lit("soft"))).alias("o_effects"),
    )
    base = F.create_map(F.lit("narrator"), F.lit("plain"))
    merged = F.map_zip_with(base, F.coalesce("o_effects", F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(b, a))
    pairs = F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return s.join(own, "series", "left").select("series", F.coalesce("o_rate", F.lit(1.0)).alias("rate"), F.coalesce("o_lang", F.lit("en")).alias("lang"), F.array_join(pairs, ",").alias("effects"))


_VERBS = ["said", "asked", "the", "of"]  # the corpus has no speech verbs; its commonest words stand in for them


@query("str25_speech_tags", f"""WITH {TOKENS_SQL} SELECT lower(token) AS verb, prev AS name, count(*) AS n FROM tokens WHERE lower(token) IN ({", ".join(f"'{v}'" for v in _VERBS)}) AND regexp_matches(prev, '^[A-Z][a-z]+$') GROUP BY 1, 2""")
def speech_tags(spark, d):
    """A speech verb with a name right before it."""
    t = tokens(spark, d).where(F.lower("token").isin(_VERBS) & F.col("prev").rlike("^[A-Z][a-z]+$"))
    return t.groupBy(F.lower("token").alias("verb"), F.col("prev").alias("name")).agg(F.count("*").alias("n"))


@query("win11_machine_pieces")
def machine_pieces(spark, d, marker: str = "***"):
    """WIN11: pieces of chapters with a marker and whether the machine voice reads them. Lines are the blocks here, typed, so that scene breaks end a run."""
    has = lines(spark, d).join(table(spark, d, "documents").where(F.contains("text", F.lit(marker))).select("doc_id"), "doc_id", "left_semi")
    kind = F.when(T.is_scene_break(F.col("line")), "scene_break").otherwise("paragraph")
    b = has.select("doc_id", F.col("line_no").alias("block_no"), kind.alias("kind"), F.col("line").alias("body"), F.lit(False).alias("emphasised"))
    return runs.machine_runs(b, marker=marker)


@query("win11_machine_runs", """WITH p AS (SELECT doc_id, string_split(text, '*') AS ps FROM documents WHERE contains(text, '*')), q AS (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)
SELECT doc_id, count(*) FILTER (i % 2 = 0 AND trim(ps[i]) <> '') AS n_machine, count(*) FILTER (i % 2 = 1 AND trim(ps[i]) <> '') AS n_plain, len(any_value(ps)) % 2 = 0 AS unclosed FROM q GROUP BY doc_id""")
def machine_runs(spark, d):
    """A marker toggles the machine voice; an odd number of markers leaves the last run open."""
    ps = F.split("text", r"\*", -1)
    full = lambda odd: F.size(F.filter(F.transform(ps, lambda x, i: F.when((i % 2 == odd) & (F.trim(x) != ""), x)), lambda x: x.isNotNull())).cast("bigint")
    return table(spark, d, "documents").where(F.contains("text", F.lit("*"))).select("doc_id", full(1).alias("n_machine"), full(0).alias("n_plain"), (F.size(ps) % 2 == 0).alias("unclosed"))


@query("win20_emphasis_blocks", r"""WITH p AS (SELECT page_id, string_split(html, '<p>')[2:] AS ps FROM pages), b AS (SELECT page_id, unnest(range(len(ps)))::INT AS block_no, unnest(ps) AS x FROM p),
n AS (SELECT page_id, block_no, length(regexp_replace(x, '<[^>]*>', '', 'g')) AS n_chars, length(array_to_string(regexp_extract_all(x, '<b>([^<]*)', 1), '')) AS n_bold FROM b)
SELECT *, n_chars > 0 AND 10 * n_bold >= 6 * n_chars AS thought FROM n""")
def emphasis_blocks(spark, d):
    """How much of each block is emphasised; six tenths or more make it a thought."""
    parts = F.split("html", "<p>", -1)
    b = table(spark, d, "pages").select("page_id", F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("block_no", "x"))
    chars, bold = F.length(F.regexp_replace("x", "<[^>]*>", "")).cast("bigint"), F.length(F.array_join(F.regexp_extract_all("x", F.lit("<b>([^<]*)"), F.lit(1)), "")).cast("bigint")
    n = b.select("page_id", "block_no", chars.alias("n_chars"), bold.alias("n_bold"))
    return n.withColumn("thought", (F.col("n_chars") > 0) & (10 * F.col("n_bold") >= 6 * F.col("n_chars")))


def emphasised_blocks(spark, d):
    """(page_id, block_no, text, spans): what follows each <p> of a page, without tags, with the spans of its emphasis."""
    parts = F.split("html", "<p>", -1)
    b = table(spark, d, "pages").select("page_id", F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("block_no", "x"))
    return b.select("page_id", "block_no", spans.tagged_text(F.col("x")).alias("t")).select("page_id", "block_no", "t.text", "t.spans")


#: The same blocks, with a span's place as the length of all text before it.
_SPANS_SQL = rf"""ps AS (SELECT page_id, string_split(html, '<p>')[2:] AS ps FROM pages), xs AS (SELECT page_id, unnest(range(len(ps)))::INT AS block_no, unnest(ps) AS x FROM ps),
bits AS (SELECT page_id, block_no, regexp_extract_all(x, '<[^>]*>|[^<]+|<') AS bs FROM xs),
blocks AS (SELECT page_id, block_no, array_to_string(list_filter(bs, lambda y: NOT regexp_matches(y, '^<[^>]*>$')), '') AS line FROM bits),
bold AS (SELECT page_id, block_no, length(array_to_string(list_filter(bs[:i - 1], lambda y: NOT regexp_matches(y, '^<[^>]*>$')), ''))::INT AS a, length(bs[i])::INT AS n
  FROM (SELECT *, unnest(range(2, len(bs) + 1)) AS i FROM bits) WHERE bs[i - 1] = '<b>' AND NOT regexp_matches(bs[i], '^<[^>]*>$')),
cut AS (SELECT page_id, block_no, string_split(regexp_replace(regexp_replace(line, '\b({"|".join(T.ABBREVIATIONS)})\.', '\1{corpus._HOLD}', 'g'), '([.!?…][.!?…"'')\]]*)([ \t\n]*)([\p{{Lu}}"''(\[])', '\1\2{T.CUT}\3', 'g'), '{T.CUT}') AS parts FROM blocks),
sents AS (SELECT *, row_number() OVER (PARTITION BY page_id, block_no ORDER BY k)::INT - 1 AS sent_no FROM (
  SELECT page_id, block_no, k, (length(array_to_string(parts[1:k - 1], '')) + length(parts[k]) - length(ltrim(parts[k])))::INT AS start, length(trim(parts[k]))::INT AS n_chars FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM cut)) WHERE n_chars > 0),
inside AS (SELECT s.page_id, s.block_no, s.sent_no, s.start, s.n_chars, CASE WHEN b.a IS NOT NULL THEN greatest(b.a, s.start) - s.start END AS a, CASE WHEN b.a IS NOT NULL THEN least(b.a + b.n, s.start + s.n_chars) - s.start END AS b
  FROM sents s LEFT JOIN bold b ON b.page_id = s.page_id AND b.block_no = s.block_no AND least(b.a + b.n, s.start + s.n_chars) > greatest(b.a, s.start))"""


@query("win20_emphasis_sentences", f"""WITH {_SPANS_SQL} SELECT page_id, block_no, sent_no, start, n_chars, coalesce(sum(b - a), 0)::INT AS n_bold, 10 * coalesce(sum(b - a), 0) >= 6 * n_chars AS thought FROM inside GROUP BY page_id, block_no, sent_no, start, n_chars""")
def emphasis_sentences(spark, d):
    """How much of each sentence is emphasised: the block's spans are clipped and re-based to the sentence. Six tenths or more make it a thought."""
    s = emphasised_blocks(spark, d).select("page_id", "block_no", "spans", F.posexplode(spans.sentences(F.col("text"))).alias("sent_no", "s"))
    n = F.length("s.body")
    bold = spans.covered(spans.rebased(F.col("spans"), F.col("s.start"), F.col("s.start") + n))
    return s.select("page_id", "block_no", "sent_no", "s.start", n.alias("n_chars"), bold.alias("n_bold")).withColumn("thought", 10 * F.col("n_bold") >= 6 * F.col("n_chars"))


@query("win21_text_spans", f"WITH {_SPANS_SQL} SELECT page_id, block_no, sent_no, a, b FROM inside WHERE b IS NOT NULL")
def text_spans(spark, d):
    """WIN21, STR1: emphasis spans merged in a block, then clipped and re-based onto its sentences."""
    s = emphasised_blocks(spark, d).where(F.size("spans") > 0).select("page_id", "block_no", "spans", F.posexplode(spans.sentences(F.col("text"))).alias("sent_no", "s"))
    return s.select("page_id", "block_no", "sent_no", F.inline(spans.rebased(F.col("spans"), F.col("s.start"), F.col("s.start") + F.length("s.body"))))


@query("win20_emphasis_share", r"""SELECT page_id, length(regexp_replace(array_to_string(regexp_extract_all(html, '<b>([^<]*)', 1), ''), '\s', '', 'g')) AS n_bold, length(regexp_extract(html, '(?s)<article>(.*)</article>', 1)) AS n_article FROM pages""")
def emphasis_share(spark, d):
    """Characters under emphasis beside the article's length."""
    bold = F.regexp_replace(F.array_join(F.regexp_extract_all("html", F.lit("<b>([^<]*)"), F.lit(1)), ""), r"\s", "")
    return table(spark, d, "pages").select("page_id", F.length(bold).cast("bigint").alias("n_bold"), F.length(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1)).cast("bigint").alias("n_article"))


#: Letters to sounds, roughly, in place of a phonemizer: pattern and replacement, in order.
SOUNDS = [("n([kg])", "ŋ$1"), ("([aeiou])s$", "$1z"), ("e$", ""), ("er$", "ɚ"), ("^([a-z]{1,2})o", "$1ʌ"), ("a([a-z]{6,})", "ə$1")]


def sounds(word):
    for pattern, to in SOUNDS:
        word = F.regexp_replace(word, pattern, to)
    return word


def _sounds_sql(word: str) -> str:
    for pattern, to in SOUNDS:
        word = f"regexp_replace({word}, '{pattern}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return word


_BARE = "regexp_replace({0}, '[aeiouɐəɚɪɛʌʊɔɑæɜᵻɒ]', '', 'g')"


@query("str22_sound_classes", rf"""WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark), s AS (SELECT DISTINCT ws[i] AS a, ws[i + 1] AS b FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM w)),
p AS (SELECT a || b AS word, a AS left_part, b AS right_part, {_sounds_sql("a")} AS pa, {_sounds_sql("b")} AS pb, {_sounds_sql("a || b")} AS whole FROM s),
q AS (SELECT *, pa || pb AS parts FROM p)
SELECT word, left_part, right_part, whole, pa || ' ' || pb AS split, CASE WHEN parts = whole THEN CASE WHEN right(pa, 1) || left(pb, 1) IN ('tʃ', 'dʒ', 'tj', 'dj') THEN 'joins' ELSE 'ok' END
  WHEN replace(parts, 'ŋ', 'n') = replace(whole, 'ŋ', 'n') AND len(list_filter(range(1, length(whole) + 1), lambda i: parts[i] <> whole[i] AND NOT (parts[i] = 'n' AND whole[i] = 'ŋ'))) = 0 THEN 'n→ng'
  WHEN regexp_replace(parts, '[sz]', '', 'g') = regexp_replace(whole, '[sz]', '', 'g') THEN 's/z' WHEN {_BARE.format("parts")} = {_BARE.format("whole")} THEN 'vowel' ELSE 'differs' END AS why FROM q""")
def sound_classes(spark, d):
    """STR22, UDF2: words put together from two neighbours of ``benchmark``: how the sounds of the whole differ from those of its halves, over a table of words and sounds."""
    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    pair = lambda w, i: F.struct(w.alias("left_part"), F.get(ws, i + 1).alias("right_part"))
    s = table(spark, d, "benchmark").select(F.inline(F.transform(ws, pair))).where("right_part IS NOT NULL").distinct().withColumn("word", F.concat("left_part", "right_part"))
    known = s.select(F.explode(F.array("word", "left_part", "right_part")).alias("word")).distinct()
    return hooks.judged(s, known.withColumn("phonemes", sounds(F.col("word"))))
