"""Reports over the whole corpus: blocks, sentences, names, heteronyms, interjections, compounds, shared lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serialmill.functions import spans
from serialmill.functions import text as T
from serialmill.operators.registry import registry
from serialmill.sources.bindings import LINES_SQL, lines, table

QUERIES, ORACLES, query = registry()

# Capitalised words that are no names.
STOPWORDS = """A About After Ahh Alright An And As At Because Before But By Can Could Did Do Down
Even Every For From Gods God Had Has Have He Her Here His How I If In Is It Its Just Last Let Like Man Maybe My No Nor
Not Now Of Oh On Once Only Or Really Right She Since So Some Still That The Their Then There These They This Those To Up
Was We Well What When Where While Who Why With Yeah Yes You Your Lord Lady Church Sir""".split()

# Words with two readings.
HETERONYMS = """tear bow wind lead read live wound bass close does minute object produce project content desert present
record refuse use invalid moderate separate house excuse entrance contract conduct console convict defect digest discount
escort export import insult permit rebel subject suspect address attribute combine compact compound compress conflict
contest contrast decrease increase extract incline intern perfect progress protest recall reject survey polish sow dove row
buffet resume graduate advocate estimate elaborate delegate duplicate articulate""".split()

# Families of interjections, first match wins, and initialisms that are none.
FAMILIES = [
    ("hm", "^h+m+p*f*h*$"), ("mm", "^m+h*$"), ("ah", "^a+h+$"), ("oh", "^o+h+$|^o+o+h+$"), ("uh", "^u+h+$"), ("eh", "^e+h+$"), ("er", "^e+r+m*$"), ("um", "^u+m+$"),
    ("ugh", "^u+g+h+$"), ("argh", "^a+r+g+h+$"), ("tsk", "^t+s+k+$|^t+c+h+$"), ("pff", "^p+f+t*$|^p+s+s+t+$"), ("grr", "^g+r+$|^b+r+r+$"), ("shh", "^s+h+$|^s+s+h+$"),
    ("huh", "^h+u+h+$"), ("heh", "^h+e+h+$|^h+a+h+$"), ("ow", "^o+w+$|^o+o+f+$"), ("nng", "^n+g+h*$|^n+n+h*$"), ("gah", "^g+a+h+$|^b+a+h+$"), ("whoa", "^w+h+o+a+$"),
    ("aw", "^a+w+$"), ("ew", "^e+w+$"), ("yay", "^y+a+y+$"),
]
INITIALISMS = "mr mrs ms dr st jr sr pc tv th nd rd ld hp mp hq pvp npc xp dps cj jj tj dj bb gg ff".split()


def _sql_list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def tokens(spark, d: str) -> DataFrame:
    """White-space tokens of each line with the token before: one scan, one window-free pass."""
    t = lines(spark, d).select("doc_id", "source", "line_no", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ").alias("ws"))
    token = lambda w, i: F.struct(i.alias("pos"), w.alias("token"), F.get("ws", i - 1).alias("prev"))
    return t.select("doc_id", "source", "line_no", F.inline(F.transform("ws", token)))


TOKENS_SQL = LINES_SQL + r""", ws AS (
  SELECT doc_id, source, line_no, string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ') AS ws FROM lines
), tokens AS (
  SELECT doc_id, source, line_no, i - 1 AS pos, ws[i] AS token, CASE WHEN i > 1 THEN ws[i - 1] END AS prev FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM ws)
)"""

NAMES_SQL = f"""names AS (
  SELECT source, doc_id, line_no, pos, regexp_extract(token, '^[A-Za-z][A-Za-z''-]+') AS word FROM tokens
  WHERE regexp_matches(regexp_extract(token, '^[A-Za-z][A-Za-z''-]+'), '^[A-Z][a-z][a-z]+$') AND prev IS NOT NULL AND NOT regexp_matches(regexp_replace(prev, '["'']+$', ''), '[.!?…]$')
    AND regexp_extract(token, '^[A-Za-z][A-Za-z''-]+') NOT IN ({_sql_list(STOPWORDS)})
)"""


#: A capitalised word in mid-sentence: a token before it, which ends no sentence even without its quotes.
_NAME = r"""(?=[A-Z][a-z]{2})(?<=\S )(?<![.!?…]["']{0,20} )([A-Z][a-z]{2,})(?![A-Za-z'-])"""


def names(spark, d: str) -> DataFrame:
    """Capitalised words in mid-sentence, found by one pattern; no other token is ever a row."""
    line = F.trim(F.regexp_replace("line", r"\s+", " "))
    t = lines(spark, d).select("source", "doc_id", "line_no", F.explode(F.regexp_extract_all(line, F.lit(_NAME), F.lit(1))).alias("word"))
    return t.where(~F.col("word").isin(STOPWORDS))


@query("agg1_unknown_names", f"WITH {TOKENS_SQL}, {NAMES_SQL} SELECT source, word, count(*) AS n FROM names GROUP BY source, word")
def unknown_names(spark, d):
    return names(spark, d).groupBy("source", "word").agg(F.count("*").alias("n"))


@query("joi3_names_not_known", f"""WITH {TOKENS_SQL}, {NAMES_SQL}, known AS (SELECT word FROM names GROUP BY word HAVING count(*) >= 5)
SELECT word, count(*) AS n FROM names ANTI JOIN known USING (word) GROUP BY word""")
def names_not_known(spark, d):
    """Candidates without a rule; the rule table here has the names used five times or more."""
    n = names(spark, d)
    known = n.groupBy("word").count().where("count >= 5").select("word")
    return n.join(known, "word", "left_anti").groupBy("word").agg(F.count("*").alias("n"))


@query("set2_known_surfaces", f"WITH {TOKENS_SQL}, {NAMES_SQL} SELECT word FROM names WHERE source = 'src0' UNION SELECT word FROM names WHERE source = 'src1'")
def known_surfaces(spark, d):
    n = names(spark, d)
    return n.where("source = 'src0'").select("word").union(n.where("source = 'src1'").select("word")).distinct()


@query("set4_append_candidates", f"""WITH {TOKENS_SQL}, {NAMES_SQL}
SELECT lower(word) AS surface, count(*) AS n FROM names WHERE source <> 'src0' AND lower(word) NOT IN (SELECT lower(word) FROM names WHERE source = 'src0') GROUP BY 1""")
def append_candidates(spark, d):
    """Candidates not yet in the file (src0's names), without regard to case."""
    n = names(spark, d).withColumn("surface", F.lower("word"))
    have = n.where("source = 'src0'").select("surface").distinct()
    return n.where("source <> 'src0'").join(have, "surface", "left_anti").groupBy("surface").agg(F.count("*").alias("n"))


_EDGES = "\"'’“”‘()\\[\\]{}.,!?;:…—–*"  # fixed values: punctuation around a word


@query("agg2_heteronyms", f"""WITH w AS (
  SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS ws FROM documents
), t AS (
  SELECT doc_id, ws, i, lower(regexp_replace(regexp_replace(ws[i], '^[{_EDGES.replace("'", "''")}]+', ''), '[{_EDGES.replace("'", "''")}]+$', '')) AS core FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)
), h AS (
  SELECT core, doc_id, i, array_to_string(ws[greatest(1, i - 6):i + 6], ' ') AS snippet FROM t WHERE core IN ({_sql_list(HETERONYMS)})
)
SELECT core AS word, count(*) AS n, arg_min(snippet, (doc_id, i)) AS snippet FROM h GROUP BY core""")
def heteronyms(spark, d, context: int = 6):
    """Each known heteronym: occurrences, and the first in its context."""
    known = F.array(*map(F.lit, HETERONYMS))
    some = table(spark, d, "documents").where(F.arrays_overlap(F.split(F.lower("text"), "[^a-z]+"), known))  # letters alone decide which texts are looked at
    ws = some.select("doc_id", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("ws"))
    core = lambda w: F.lower(F.regexp_replace(w, f"^[{_EDGES}]+|[{_EDGES}]+$", ""))
    hit = F.filter(F.transform("ws", lambda w, i: F.struct(core(w).alias("core"), i.alias("i"))), lambda x: x["core"].isin(HETERONYMS))
    h = ws.select("doc_id", "ws", F.inline(hit))
    snippet = F.array_join(F.slice("ws", F.greatest(F.lit(1), F.col("i") + 1 - context), F.least(F.lit(2 * context + 1), F.col("i") + 1 + context)), " ")
    first = F.min_by(snippet, F.struct("doc_id", "i"))
    return h.groupBy(F.col("core").alias("word")).agg(F.count("*").alias("n"), first.alias("snippet"))


def family_of(core):
    out = F.when(core.isin(INITIALISMS), None)
    for name, pattern in FAMILIES:
        out = out.when(core.rlike(pattern), name)
    # a run of three equal letters, then words without vowels
    return out.when(core.rlike(r"(.)\1{2,}"), "stretched").when((F.length(core) >= 3) & ~core.rlike("[aeiouy]"), "vowelless")


_RUNS = " OR ".join(f"contains(core, '{c * 3}')" for c in "abcdefghijklmnopqrstuvwxyz")


#: What every word of a family looks like before its edges are trimmed; few other words do.
_PERHAPS = "^['-]*(?:" + "|".join(x.strip("^$") for _, p in FAMILIES for x in p.split("|")) + r")(?:'s)?['-]*$|(.)\1{2,}|^[^aeiouy]{3,}$"


@query("agg5_interjections", f"""WITH t AS (
  SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z][a-z''’-]*')) AS raw FROM documents
), c AS (
  SELECT doc_id, source, regexp_replace(regexp_replace(raw, '^[''-]+|[''-]+$', '', 'g'), '''s$', '') AS core FROM t
), f AS (
  SELECT *, CASE WHEN core IN ({_sql_list(INITIALISMS)}) THEN NULL {' '.join(f"WHEN regexp_matches(core, '{p}') THEN '{n}'" for n, p in FAMILIES)}
    WHEN {_RUNS} OR contains(core, '’’’') THEN 'stretched' WHEN length(core) >= 3 AND NOT regexp_matches(core, '[aeiouy]') THEN 'vowelless' END AS family FROM c
)
SELECT family, source, count(*) AS n, count(DISTINCT core) AS spellings, count(DISTINCT doc_id) AS n_docs FROM f WHERE family IS NOT NULL GROUP BY family, source""")
def interjections(spark, d):
    """Only words that may belong to a family are shuffled, counted for each document first."""
    t = table(spark, d, "documents").select("doc_id", "source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z'’-]*"), F.lit(0))).alias("raw"))
    core = F.regexp_replace(F.regexp_replace("raw", "^['-]+|['-]+$", ""), "'s$", "")
    few = t.where(F.col("raw").rlike(_PERHAPS)).select("doc_id", "source", core.alias("core")).groupBy("doc_id", "source", "core").count()
    f = few.withColumn("family", family_of(F.col("core"))).where("family IS NOT NULL")
    return f.groupBy("family", "source").agg(F.sum("count").alias("n"), F.count_distinct("core").alias("spellings"), F.count_distinct("doc_id").alias("n_docs"))


LEAST_USES = 40
WORDS_SQL = "words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"


def word_counts(spark, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("agg6_vocabulary", f"WITH {WORDS_SQL} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM words GROUP BY word HAVING count(*) >= {LEAST_USES}")
def vocabulary(spark, d):
    return word_counts(spark, d).where(F.col("n") >= LEAST_USES)


# Endings that are read weakly and so are no second half, and endings of inflected words.
WEAK_ENDINGS = "less able ible ness ment ship hood ful fully ward wards wise ish ling ings man men land worth ways time".split()
INFLECTIONS = "ing ed es s ly er ers est ist ists ier ies ie ate ity ities".split()
#: The stems that an ending may have cut short: as it stands, with an e, without its last letter, and that with a y.
_INFLECTION = f"({'|'.join(INFLECTIONS)})$"

_STEMS_SQL = f"""stems AS (SELECT word, unnest([stem, stem || 'e', left(stem, -1), left(stem, -1) || 'y']) AS stem FROM (SELECT word, regexp_replace(word, '(ities|ists|ing|ers|est|ist|ier|ies|ate|ity|ed|es|ly|er|ie|s)$', '') AS stem FROM v)
  WHERE stem <> word AND stem <> '')"""


def dictionary(spark, d: str) -> DataFrame:
    """The word list that a compound is not in and its halves are: here the words of ``benchmark``."""
    return table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()


@query("agg7_compounds", rf"""WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c AS (SELECT word, source, count(*) AS n FROM w GROUP BY 1, 2),
v AS (SELECT word, sum(n)::BIGINT AS n FROM c GROUP BY word), dict AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark),
used AS (SELECT word FROM v WHERE n >= {LEAST_USES} AND length(word) >= 3 AND word IN (SELECT word FROM dict)), {_STEMS_SQL},
cand AS (SELECT word, n FROM v WHERE length(word) >= 8 AND word NOT IN (SELECT word FROM dict) AND word NOT IN (SELECT s.word FROM stems s JOIN dict ON dict.word = s.stem)),
s AS (SELECT word, n, left(word, k) AS a, substr(word, k + 1) AS b, least(k, length(word) - k) AS even, greatest(k, length(word) - k) AS most, k FROM (SELECT *, unnest(range(3, length(word) - 2)) AS k FROM cand)),
best AS (SELECT word, n, a, b FROM s WHERE a IN (SELECT word FROM used) AND b IN (SELECT word FROM used) AND (even > 3 OR most >= 5) AND b NOT IN ({_sql_list(WEAK_ENDINGS)}) QUALIFY row_number() OVER (PARTITION BY word ORDER BY even DESC, k) = 1),
top AS (SELECT word, string_agg(source, ',' ORDER BY n DESC, source) AS labels FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, source) <= 4) GROUP BY word)
SELECT best.word, best.n, a AS left_part, b AS right_part, labels FROM best JOIN top USING (word)""")
def compounds(spark, d):
    """JOI4 and WIN16: words outside the dictionary, and no inflections of its words, that split into two of its words which the corpus
    uses often. The most even split decides, the first of equals; a half of three letters needs one of five; with the sources that use the word most."""
    w = table(spark, d, "documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    c = w.groupBy("word", "source").agg(F.count("*").alias("n"))
    v = c.groupBy("word").agg(F.sum("n").alias("n"))
    known = dictionary(spark, d)
    used = v.where((F.col("n") >= LEAST_USES) & (F.length("word") >= 3)).join(known, "word", "left_semi").select("word")
    size = F.length("word")
    unknown = v.where(size >= 8).join(known, "word", "left_anti")
    s = unknown.select("word", "n", size.alias("len"), F.explode(F.sequence(F.lit(3), size - 3)).alias("k"))
    s = s.select("*", F.expr("left(word, k)").alias("left_part"), F.expr("substring(word, k + 1)").alias("right_part")).where(~F.col("right_part").isin(WEAK_ENDINGS))
    s = s.where((F.least("k", F.col("len") - F.col("k")) > 3) | (F.greatest("k", F.col("len") - F.col("k")) >= 5))
    s = s.join(used.withColumnRenamed("word", "left_part"), "left_part").join(used.withColumnRenamed("word", "right_part"), "right_part")
    split = F.max_by(F.struct("left_part", "right_part"), F.struct(F.least("k", F.col("len") - F.col("k")), -F.col("k")))
    found = s.groupBy("word", "n").agg(split.alias("b"))
    stem = F.regexp_replace("word", _INFLECTION, "")
    cut = F.expr("left(stem, length(stem) - 1)")
    stems = found.select("word", stem.alias("stem")).where("stem <> word AND stem <> ''").select("word", F.explode(F.array("stem", F.concat("stem", F.lit("e")), cut, F.concat(cut, F.lit("y")))).alias("stem"))
    inflected = stems.join(known.withColumnRenamed("word", "stem"), "stem", "left_semi").select("word")
    kept = found.join(inflected, "word", "left_anti")
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.col("n").desc(), "source"))
    labels = c.join(kept.select("word"), "word", "left_semi").withColumn("place", place).where("place <= 4").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("place", "source"))).alias("l"))
    return kept.join(labels, "word").select("word", "n", "b.left_part", "b.right_part", F.array_join("l.source", ",").alias("labels"))


# --- blocks and segments


def text_blocks(t):
    """Array of struct<kind, body>: blank lines part the blocks, wrapped lines are joined, scene breaks typed."""
    unix = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    chunks = F.filter(F.transform(F.split(unix, r"\n\s*\n", -1), strip), lambda x: x != "")
    one = lambda x: F.when(T.is_scene_break(x), F.struct(F.lit("scene_break").alias("kind"), F.lit("").alias("body"))).otherwise(F.struct(F.lit("paragraph").alias("kind"), F.regexp_replace(x, r"\s*\n\s*", " ").alias("body")))
    return F.transform(chunks, one)


@query("src2_blocks", r"""WITH c AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS cs FROM documents),
b AS (SELECT doc_id, unnest(range(len(cs)))::INT AS block_no, unnest(cs) AS x FROM c), k AS (SELECT *, x IN ('***', '* * *', '---', '###', '• • •', '· · ·', '= = =') OR (length(x) <= 12 AND regexp_matches(x, '^\s*([*#~•·\-—–_=]\s*){3,}\s*$')) AS brk FROM b)
SELECT doc_id, block_no, CASE WHEN brk THEN 'scene_break' ELSE 'paragraph' END AS kind, CASE WHEN brk THEN '' ELSE regexp_replace(x, '\s*\n\s*', ' ', 'g') END AS body FROM k""")
def blocks(spark, d):
    """Plain texts as typed blocks."""
    b = table(spark, d, "documents").select("doc_id", F.posexplode(text_blocks(F.col("text"))).alias("block_no", "b"))
    return b.select("doc_id", "block_no", "b.kind", "b.body")


@query("flt8_scene_breaks", f"""WITH {LINES_SQL} SELECT doc_id, line_no, CASE WHEN trim(line) IN ('***', '* * *', '---', '###', '• • •', '· · ·', '= = =')
  OR (length(trim(line)) <= 12 AND regexp_matches(trim(line), '^\\s*([*#~•·\\-—–_=]\\s*){{3,}}\\s*$')) THEN 'scene_break' ELSE 'paragraph' END AS kind, trim(line) AS body FROM lines""")
def line_kinds(spark, d):
    """Every line by itself, typed."""
    kind = F.when(T.is_scene_break(F.col("line")), "scene_break").otherwise("paragraph")
    return lines(spark, d).select("doc_id", "line_no", kind.alias("kind"), F.trim("line").alias("body"))


@query("flt9_stat_hints", f"""WITH {LINES_SQL} SELECT doc_id, line_no FROM lines
WHERE regexp_matches(line, '(?i)\\b(HP|MP|SP|XP|EXP|STR|DEX|CON|INT|WIS|CHA|VIT|AGI|LUK)\\b\\s*[:=]|\\b(Level|Lvl|Rank|Class|Race|Title|Skill|Quest)\\b\\s*[:=]|\\b\\d+\\s*/\\s*\\d+\\b')""")
def stat_hints(spark, d):
    return lines(spark, d).where(T.has_stat_hint(F.col("line"))).select("doc_id", "line_no")


_HOLD = "\u0002"  # stands for an abbreviation's period where a pattern cannot look back

SENTENCES_SQL = LINES_SQL + f""", cut AS (
  SELECT doc_id, line_no, string_split(regexp_replace(regexp_replace(line, '\\b({"|".join(T.ABBREVIATIONS)})\\.', '\\1{_HOLD}', 'g'),
    '([.!?…][.!?…"'')\\]]*)([ \\t\\n]*)([\\p{{Lu}}"''(\\[])', '\\1\\2{T.CUT}\\3', 'g'), '{T.CUT}') AS parts FROM lines
), sentences AS (
  SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY k) - 1 AS sent_no, s AS sentence, start
  FROM (SELECT doc_id, line_no, k, trim(replace(parts[k], '{_HOLD}', '.')) AS s, (length(array_to_string(parts[1:k - 1], '')) + length(parts[k]) - length(ltrim(parts[k])))::INT AS start FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM cut)) WHERE s <> ''
)"""


def sentence_rows(spark, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", "source", "line_no", F.posexplode(T.sentences(F.col("line"))).alias("sent_no", "sentence"))


@query("str1_sentences", f"WITH {SENTENCES_SQL} SELECT doc_id, line_no, sent_no, start, sentence FROM sentences")
def sentence_split(spark, d):
    """Sentences with their places in the line."""
    s = lines(spark, d).select("doc_id", "line_no", F.posexplode(spans.sentences(F.col("line"))).alias("sent_no", "s"))
    return s.select("doc_id", "line_no", "sent_no", "s.start", F.col("s.body").alias("sentence"))


PAUSES = {"sentence": 250, "paragraph": 600, "ellipsis": 300}


@query("win22_segments", f"""WITH {SENTENCES_SQL}, s AS (
  SELECT *, lead(sent_no) OVER (PARTITION BY doc_id, line_no ORDER BY sent_no) IS NULL AS para_end FROM sentences
)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, sent_no) - 1 AS seg_no, sentence AS body, para_end,
  CASE WHEN regexp_matches(sentence, '^[\\s.…]+$') THEN 'pause' WHEN NOT regexp_matches(sentence, '[\\p{{L}}\\p{{N}}]') THEN 'pause' ELSE 'speech' END AS kind,
  CASE WHEN para_end THEN {PAUSES["paragraph"]} ELSE {PAUSES["sentence"]} END + CASE WHEN regexp_matches(sentence, '^[\\s.…]+$') THEN {PAUSES["ellipsis"]} ELSE 0 END AS pause_ms
FROM s""")
def segments(spark, d):
    """FLT16, WIN12, WIN22: the segment script; lines without a letter or digit become pauses. A chapter's segments are numbered on its own row, without a shuffle."""
    ended = lambda s: F.transform(s, lambda x, i: F.struct(x.alias("body"), (i == F.size(s) - 1).alias("para_end")))
    whole = F.flatten(F.transform(F.split("text", "\n", -1), lambda x: T.bound(T.sentences(x), ended)))
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(whole).alias("seg_no", "s")).select("doc_id", "seg_no", "s.body", "s.para_end")
    ellipsis, silent = F.col("body").rlike(r"^[\s.…]+$"), ~F.col("body").rlike(r"[\p{L}\p{N}]")
    pause = F.when(F.col("para_end"), PAUSES["paragraph"]).otherwise(PAUSES["sentence"]) + F.when(ellipsis, PAUSES["ellipsis"]).otherwise(0)
    return rows.select("doc_id", "seg_no", "body", "para_end", F.when(ellipsis | silent, "pause").otherwise("speech").alias("kind"), pause.alias("pause_ms"))


@query("hsh1_segment_keys", f"WITH {SENTENCES_SQL} SELECT sha1(sentence || '|narrator|narration|1.0|1.0|24000') AS key, count(*) AS uses, count(DISTINCT doc_id) AS n_docs FROM sentences GROUP BY 1")
def segment_keys(spark, d):
    """Digest of text, voice, style, rate, pitch and sample rate; equal segments share one cache entry."""
    key = F.sha1(F.concat_ws("|", "sentence", F.lit("narrator"), F.lit("narration"), F.lit("1.0"), F.lit("1.0"), F.lit("24000")))
    return sentence_rows(spark, d).groupBy(key.alias("key")).agg(F.count("*").alias("uses"), F.count_distinct("doc_id").alias("n_docs"))


@query("agg24_recipe_hash", f"""WITH {SENTENCES_SQL} SELECT doc_id, left(sha256(string_agg(sentence, chr(1) ORDER BY line_no, sent_no) || '|24000'), 32) AS recipe FROM sentences GROUP BY doc_id""")
def recipe_hash(spark, d):
    """A digest of a chapter's segments and settings, on its own row."""
    whole = F.flatten(F.transform(F.split("text", "\n", -1), T.sentences))
    docs = table(spark, d, "documents").select("doc_id", whole.alias("s")).where(F.size("s") > 0)
    return docs.select("doc_id", F.left(F.sha2(F.concat(F.array_join("s", T.CUT), F.lit("|24000")), 256), F.lit(32)).alias("recipe"))


@query("agg18_chapter_stats", f"""WITH {SENTENCES_SQL}, w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n_words FROM documents),
b AS (SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (trim(line) IN ('***', '* * *', '---', '###', '• • •', '· · ·', '= = =') OR (length(trim(line)) <= 12 AND regexp_matches(trim(line), '^\\s*([*#~•·\\-—–_=]\\s*){{3,}}\\s*$'))) AS n_breaks FROM lines GROUP BY doc_id),
s AS (SELECT doc_id, count(*) FILTER (regexp_matches(sentence, '[\\p{{L}}\\p{{N}}]')) AS n_speech, count(*) FILTER (NOT regexp_matches(sentence, '[\\p{{L}}\\p{{N}}]')) AS n_pauses FROM sentences GROUP BY doc_id)
SELECT doc_id, n_blocks, n_breaks, coalesce(n_speech, 0) AS n_speech, coalesce(n_pauses, 0) AS n_pauses, n_words, round(n_words / 155.0, 2)::DOUBLE AS minutes, round(n_words / 2.7, 1)::DOUBLE AS seconds FROM w JOIN b USING (doc_id) LEFT JOIN s USING (doc_id)""")
def chapter_stats(spark, d):
    """Kinds of blocks and of segments, words, and time at 155 words a minute and 2.7 a second, on a chapter's own row."""
    n = F.size(F.array_remove(F.split("text", r"\s+"), "")).cast("bigint")
    count = lambda a, on: F.size(F.filter(a, on)).cast("bigint")
    full = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x)) > 0)
    said = lambda x: x.rlike(r"[\p{L}\p{N}]")
    docs = table(spark, d, "documents").select("doc_id", n.alias("n_words"), full.alias("lines")).where(F.size("lines") > 0).select("*", F.flatten(F.transform("lines", T.sentences)).alias("s"))
    return docs.select(
        "doc_id", F.size("lines").cast("bigint").alias("n_blocks"), count("lines", T.is_scene_break).alias("n_breaks"), count("s", said).alias("n_speech"), count("s", lambda x: ~said(x)).alias("n_pauses"), "n_words",
        F.round(F.col("n_words") / 155.0, 2).alias("minutes"), F.round(F.col("n_words") / 2.7, 1).alias("seconds"),
    )


@query("agg21_shared_keys", f"WITH {LINES_SQL} SELECT sha1(line) AS key, count(DISTINCT source) AS n_series, count(*) AS uses FROM lines GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def shared_keys(spark, d):
    g = lines(spark, d).groupBy(F.sha1("line").alias("key")).agg(F.count_distinct("source").alias("n_series"), F.count("*").alias("uses"))
    return g.where("n_series >= 2")


@query("set5_keys_in_both", f"WITH {LINES_SQL} SELECT sha1(line) AS key FROM lines WHERE source = 'src0' INTERSECT SELECT sha1(line) FROM lines WHERE source = 'src1'")
def keys_in_both(spark, d):
    k = lambda s: lines(spark, d).where(F.col("source") == s).select(F.sha1("line").alias("key"))
    return k("src0").intersect(k("src1"))


@query("set6_title_row", f"""WITH {LINES_SQL} SELECT doc_id, line_no + 1 AS seg_no, line AS body FROM lines UNION ALL SELECT doc_id, 0, 'Chapter ' || doc_id FROM documents""")
def title_row(spark, d):
    head = table(spark, d, "documents").select("doc_id", F.lit(0).alias("seg_no"), F.concat(F.lit("Chapter "), F.col("doc_id").cast("string")).alias("body"))
    return lines(spark, d).select("doc_id", (F.col("line_no") + 1).alias("seg_no"), F.col("line").alias("body")).unionByName(head)


@query("snk2_markdown", f"""WITH {LINES_SQL} SELECT doc_id, '---' || chr(10) || 'source: ' || any_value(source) || chr(10) || '---' || chr(10) || chr(10) || string_agg(trim(line), chr(10) || chr(10) ORDER BY line_no) AS markdown FROM lines GROUP BY doc_id""")
def markdown(spark, d):
    """Front matter and paragraphs of each chapter."""
    para = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    head = F.concat(F.lit("---\nsource: "), "source", F.lit("\n---\n\n"))
    return table(spark, d, "documents").where(F.size(para) > 0).select("doc_id", F.concat(head, F.array_join(para, "\n\n")).alias("markdown"))


# --- scalar functions over whole columns


@query("str18_short_titles", r"""SELECT p_partkey, CASE WHEN b <> '' THEN b ELSE trim(t) END AS title FROM (
  SELECT p_partkey, t, regexp_replace(regexp_replace(regexp_replace(t, '\s*(\[[^\]]*\]|\([^)]*\))', '', 'g'), '[ \t\n\r]+', ' ', 'g'), '^[ \-–—:,;]+|[ \-–—:,;]+$', '', 'g') AS b
  FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' [Book 1 Completed]' WHEN 1 THEN '(' || p_type || ')' ELSE p_name || ' (' || p_brand || ') - ' END AS t FROM part))""")
def short_titles(spark, d):
    k = F.col("p_partkey") % 3
    t = F.when(k == 0, F.concat("p_name", F.lit(" [Book 1 Completed]"))).when(k == 1, F.concat(F.lit("("), "p_type", F.lit(")"))).otherwise(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") - ")))
    return table(spark, d, "part").select("p_partkey", T.short_title(t).alias("title"))


@query("str19_slugs", r"""SELECT p_partkey, regexp_replace(CASE WHEN length(s) > 40 THEN CASE WHEN contains(left(s, 41), '-') THEN regexp_replace(left(s, 41), '-[^-]*$', '') ELSE left(s, 40) END ELSE s END, '-+$', '') AS slug,
  left(regexp_replace(regexp_replace(trim(t), '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g'), 120) AS path_token
FROM (SELECT p_partkey, t, regexp_replace(regexp_replace(lower(regexp_replace(t, '\[[^\]]*\]|\([^)]*\)|\{[^}]*\}', ' ', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s
  FROM (SELECT *, p_name || ' [' || p_brand || '] ' || p_type || ' and ' || p_name AS t FROM part))""")
def slugs(spark, d):
    """A short handle, and a token that is safe in a path."""
    title = F.concat("p_name", F.lit(" ["), "p_brand", F.lit("] "), "p_type", F.lit(" and "), "p_name")
    return table(spark, d, "part").select("p_partkey", T.series_slug(title).alias("slug"), T.path_token(title).alias("path_token"))


@query("flt15_slug_problems", r"""SELECT p_partkey, CASE WHEN s = '' THEN 'empty' WHEN length(s) > 60 THEN 'too long' WHEN NOT regexp_matches(s, '^[a-z0-9][a-z0-9-]*$') OR ends_with(s, '-') OR contains(s, '--') THEN 'bad characters' END AS problem
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(replace(p_name, ' ', '-')) WHEN 1 THEN p_name WHEN 2 THEN '' ELSE repeat(lower(replace(p_name, ' ', '-')), 6) END AS s FROM part)""")
def slug_problems(spark, d):
    low, k = F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.col("p_partkey") % 4
    s = F.when(k == 0, low).when(k == 1, F.col("p_name")).when(k == 2, "").otherwise(F.repeat(low, 6))
    return table(spark, d, "part").select("p_partkey", T.slug_problem(s).alias("problem"))


@query("str26_log_fields", r"SELECT doc_id, left(regexp_replace(text, '[^\x20-\x7E]', '?', 'g'), 120) AS field FROM documents")
def log_fields(spark, d):
    return table(spark, d, "documents").select("doc_id", F.left(F.regexp_replace("text", r"[^\x20-\x7E]", "?"), F.lit(120)).alias("field"))


@query("agg9_evaluation", """WITH p AS (SELECT l.doc_id, d.lang, l.quality AS gold, CASE WHEN d.n_chars % 13 = 0 THEN NULL WHEN d.n_chars > 400 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d USING (doc_id))
SELECT lang, count(*) AS n, round(avg((pred = gold)::INT), 6) AS accuracy, round(avg((pred IS NULL)::INT), 6) AS abstained, max(gold) AS top FROM p GROUP BY lang""")
def evaluation(spark, d):
    """AGG9: accuracy and share of abstentions against gold labels."""
    pred = F.when(F.col("n_chars") % 13 == 0, None).when(F.col("n_chars") > 400, 1).otherwise(0)
    p = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", pred.alias("pred")), "doc_id")
    hit = F.avg((F.col("pred") == F.col("quality")).cast("int"))
    return p.groupBy("lang").agg(F.count("*").alias("n"), F.round(hit, 6).alias("accuracy"), F.round(F.avg(F.col("pred").isNull().cast("int")), 6).alias("abstained"), F.max("quality").alias("top"))


@query("agg10_majority_baseline", """WITH c AS (SELECT d.source, l.quality AS label, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2)
SELECT source, max(n) / sum(n)::DOUBLE AS baseline, count(*) = 1 AS never_varied FROM c GROUP BY source""")
def majority_baseline(spark, d):
    c = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "quality").count()
    return c.groupBy("source").agg((F.max("count") / F.sum("count")).alias("baseline"), (F.count("*") == 1).alias("never_varied"))
