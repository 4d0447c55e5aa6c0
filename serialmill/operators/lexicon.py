"""The lexicon over the corpus: a rule table of the words and phrases of ``benchmark``, resolved and applied line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialmill.functions import lexicon as L
from serialmill.operators.registry import registry
from serialmill.sources.bindings import LINES_SQL, lines, table

QUERIES, ORACLES, query = registry()

KEYS = ["doc_id", "line_no"]
#: The mark of a rule by its gram's hash: half of the word rules fit any word.
MARKS = ["", "NOUN", "", "VERB", "", "VBD", "", "NNS+*"]


def corpus_rules(spark, d: str) -> DataFrame:
    """Rules: every word of ``benchmark`` and every run of two or three of its words. A rule takes its respelling from the row of ``part`` that its
    hash names (blank for one in eleven), its mark from MARKS; a lemma is the surface without its last letter. A third of the marked words have a plain rule as well."""
    ws = F.split(F.lower("text"), " ")
    gram = lambda n: F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "))
    grams = F.concat(*[F.when(F.size(ws) >= n, gram(n)).otherwise(F.array()) for n in (1, 2, 3)])
    g = table(spark, d, "benchmark").select(F.explode(grams).alias("surface")).where(F.col("surface").rlike("^[a-z]+( [a-z]+)*$")).distinct()
    part = table(spark, d, "part")
    h = F.conv(F.left(F.md5("surface"), F.lit(7)), 16, 10).cast("bigint")
    g = g.withColumn("h", h).join(F.broadcast(part.agg(F.count("*").alias("n_parts"))))
    r = g.withColumn("p_partkey", F.col("h") % F.col("n_parts")).join(part.select("p_partkey", "p_name"), "p_partkey")
    mark = F.when(F.contains("surface", F.lit(" ")), "").otherwise(F.get(F.array(*map(F.lit, MARKS)), (F.col("h") % 8).cast("int")))
    lemma = F.when(F.contains(mark, F.lit("+")), F.expr("left(surface, length(surface) - 1)")).otherwise("")
    said = F.when(F.col("h") % 11 == 0, "").otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    own = F.struct(F.substring_index(mark, "+", 1).alias("pos"), lemma.alias("lemma"), said.alias("respell"))
    plain = F.struct(F.lit("").alias("pos"), F.lit("").alias("lemma"), F.reverse("p_name").alias("respell"))
    each = F.when((F.col("h") % 3 == 0) & (mark != ""), F.array(own, plain)).otherwise(F.array(own))
    return r.select("surface", F.lit(0).alias("ord"), F.inline(each))


_CASES = " ".join(f"WHEN {k} THEN '{m.split('+')[0]}'" for k, m in enumerate(MARKS))
RULES_SQL = f"""bw AS (SELECT string_split(lower(text), ' ') AS ws FROM benchmark),
grams AS (SELECT DISTINCT array_to_string(ws[i:i + n - 1], ' ') AS surface FROM (SELECT ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bw, (VALUES (1), (2), (3)) AS t(n))),
hashed AS (SELECT surface, ('0x' || left(md5(surface), 7))::BIGINT AS h FROM grams WHERE regexp_full_match(surface, '[a-z]+( [a-z]+)*')),
own AS (SELECT surface, h, contains(surface, ' ') AS phrase, 2 * len(string_split(surface, ' ')) - 1 AS n, CASE WHEN contains(surface, ' ') THEN '' ELSE CASE h % 8 {_CASES} END END AS pos,
  CASE WHEN NOT contains(surface, ' ') AND h % 8 = 7 THEN left(surface, -1) ELSE '' END AS lemma, CASE WHEN h % 11 = 0 THEN '' ELSE replace(p_name, ' ', '-') END AS respell, reverse(p_name) AS other
  FROM hashed JOIN part ON p_partkey = h % (SELECT count(*) FROM part)),
rules AS MATERIALIZED (SELECT surface, phrase, n, pos, lemma, respell FROM own UNION ALL SELECT surface, phrase, n, '', '', other FROM own WHERE h % 3 = 0 AND pos <> '')"""

_COARSE = ", ".join(f"'{c}'" for c in L.COARSE)
MATCHES_SQL = rf"""{LINES_SQL}, {RULES_SQL},
cut AS MATERIALIZED (SELECT doc_id, line_no, line, regexp_extract_all(line, '[\p{{L}}\p{{N}}_]+(?:[''’][\p{{L}}\p{{N}}_]+)*|[^\p{{L}}\p{{N}}_]+') AS ps FROM lines),
tok AS MATERIALIZED (SELECT doc_id, line_no, ps, i - 1 AS first, ps[i] AS word, i > 2 OR (i = 2 AND regexp_matches(ps[1], '^[\p{{L}}\p{{N}}_]')) AS later FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM cut) WHERE regexp_matches(ps[i], '^[\p{{L}}\p{{N}}_]')),
marked AS (SELECT doc_id, line_no, first, word, CASE WHEN later AND regexp_matches(word, '^\p{{Lu}}') THEN ['PROPN', 'NNP', lower(word)] WHEN regexp_matches(word, '^[0-9]+$') THEN ['NUM', 'CD', word]
  WHEN length(word) > 5 AND ends_with(word, 'ing') THEN ['VERB', 'VBG', lower(left(word, -3))] WHEN length(word) > 4 AND ends_with(word, 'ed') THEN ['VERB', 'VBD', lower(left(word, -2))]
  WHEN ends_with(word, 'ly') THEN ['ADV', 'RB', lower(word)] WHEN ends_with(word, 'al') THEN ['ADJ', 'JJ', lower(word)] WHEN length(word) > 3 AND ends_with(word, 's') THEN ['NOUN', 'NNS', lower(left(word, -1))]
  ELSE ['NOUN', 'NN', lower(word)] END AS m FROM tok),
single AS (SELECT * EXCLUDE (fits, rank) FROM (
  SELECT t.doc_id, t.line_no, t.first, t.first AS last, word, r.surface, r.pos, r.lemma, r.respell,
    CASE WHEN r.lemma <> '' THEN r.pos = m[2] AND r.lemma = m[3] ELSE r.pos = '' OR r.pos = CASE WHEN r.pos IN ({_COARSE}) THEN m[1] ELSE m[2] END END AS fits,
    CASE WHEN r.pos = '' THEN 0 WHEN r.pos IN ({_COARSE}) THEN 1 WHEN r.lemma = '' THEN 2 ELSE 3 END AS rank,
    m[1] IN ('ADJ', 'ADV', 'NUM', 'PROPN') AND r.pos IN ('NOUN', 'PROPN') AND count(*) FILTER (r.pos IN ('NOUN', 'PROPN')) OVER w = 1 AS lone
  FROM marked t JOIN rules r ON NOT r.phrase AND r.surface = lower(t.word) WINDOW w AS (PARTITION BY t.doc_id, t.line_no, t.first)
  ) WHERE fits OR lone QUALIFY row_number() OVER (PARTITION BY doc_id, line_no, first ORDER BY fits DESC, rank DESC) = 1),
ph AS MATERIALIZED (SELECT doc_id, line_no, first, max_by(last, n) AS last, any_value(word) AS word, max_by(surface, n) AS surface, max_by(respell, n) AS respell FROM (
  SELECT doc_id, line_no, first, first + k.n - 1 AS last, k.n, word, r.surface, r.respell
  FROM (SELECT *, lower(array_to_string(ps[first + 1:first + n], '')) AS key FROM tok, (VALUES (3), (5)) AS t(n)) AS k JOIN rules r ON r.surface = k.key AND r.n = k.n AND r.phrase AND r.respell <> '') GROUP BY doc_id, line_no, first),
held AS (
  SELECT doc_id, line_no, unnest(list_reduce(list_prepend([]::STRUCT(first BIGINT, last BIGINT, word VARCHAR, surface VARCHAR, respell VARCHAR)[], list_transform(s, lambda x: [x])),
    lambda a, x: CASE WHEN len(a) = 0 OR a[len(a)].last < x[1].first THEN list_concat(a, x) ELSE a END)) AS e
  FROM (SELECT doc_id, line_no, list({{'first': first::BIGINT, 'last': last::BIGINT, 'word': word, 'surface': surface, 'respell': respell}} ORDER BY first) AS s FROM ph GROUP BY doc_id, line_no)),
edits AS MATERIALIZED (
  SELECT doc_id, line_no, e.first AS first, e.last AS last, e.word AS word, e.surface AS surface, '' AS pos, e.respell AS respell FROM held
  UNION ALL SELECT doc_id, line_no, first, last, word, surface, pos, respell FROM single s WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.doc_id = s.doc_id AND h.line_no = s.line_no AND s.first BETWEEN h.e.first AND h.e.last))"""


def corpus_matches(spark, d: str) -> DataFrame:
    return L.matches(lines(spark, d).select(*KEYS, "line"), KEYS, "line", corpus_rules(spark, d), L.suffix_tags)


@query("joi1_rule_resolution", f"WITH {MATCHES_SQL} SELECT surface, pos, respell, count(*) AS n FROM edits GROUP BY surface, pos, respell")
def rule_resolution(spark, d):
    """Which rule each word or phrase of the corpus meets: phrases first, then by coarse mark, fine mark and lemma, with the fallback to a lone rule for a noun."""
    e = L.edits(corpus_matches(spark, d), KEYS)
    return e.groupBy(F.col("key").alias("surface"), "rule.pos", "rule.respell").agg(F.count("*").alias("n"))


@query("joi2_lexicon_pass", f"""WITH {MATCHES_SQL}, after AS (SELECT *, coalesce(lag(last) OVER (PARTITION BY doc_id, line_no ORDER BY first) + 1, 0) AS lo FROM edits WHERE respell <> ''),
parts AS (SELECT doc_id, line_no, max(last) AS last, string_agg(array_to_string(ps[lo + 1:first], '') || CASE WHEN regexp_matches(word, '^\\p{{Lu}}') THEN upper(left(respell, 1)) || substr(respell, 2) ELSE respell END, '' ORDER BY first) AS head
  FROM after JOIN cut USING (doc_id, line_no) GROUP BY doc_id, line_no)
SELECT doc_id, line_no, CASE WHEN head IS NULL THEN line ELSE head || array_to_string(ps[last + 2:], '') END AS body FROM cut LEFT JOIN parts USING (doc_id, line_no)""")
def lexicon_pass(spark, d):
    """JOI1, JOI2, STR20: every line of the corpus as the rules say it."""
    rows = lines(spark, d).select(*KEYS, "line")
    return L.applied(rows, KEYS, "line", corpus_matches(spark, d)).select(*KEYS, "body")


@query("joi2_phrase_rules", f"WITH {MATCHES_SQL} SELECT surface, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM edits WHERE contains(surface, ' ') GROUP BY surface")
def phrase_rules(spark, d):
    """Phrases of the rule table that hold, whole phrases only, none inside another."""
    found = corpus_matches(spark, d).where("phrase")  # words decide nothing about phrases
    return L.edits(found, KEYS).groupBy(F.col("key").alias("surface")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("flt18_ignored_words", f"WITH {MATCHES_SQL} SELECT r.surface, count(DISTINCT t.doc_id) AS n_docs FROM rules r LEFT JOIN tok t ON lower(t.word) = r.surface WHERE r.respell = '' AND NOT r.phrase GROUP BY r.surface")
def ignored_words(spark, d):
    """Rules with a blank respelling: the word is known and left alone; in how many texts it is a token."""
    blank = corpus_rules(spark, d).where(F.col("respell").eqNullSafe("") & ~L.is_phrase(F.col("surface"))).select("surface")
    words = F.filter(L.pieces(F.col("line")), lambda p: p.rlike(L.IS_WORD))
    seen = lines(spark, d).select("doc_id", F.explode(F.array_distinct(F.transform(words, F.lower))).alias("surface"))
    return blank.join(seen.join(F.broadcast(blank), "surface", "left_semi").distinct(), "surface", "left").groupBy("surface").agg(F.count("doc_id").alias("n_docs"))
