"""Steps of the spoken form over chapters, and the whole pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from serialmill.functions import spoken as S
from serialmill.functions import text as T
from serialmill.operators.registry import registry
from serialmill.sources.bindings import table

QUERIES, ORACLES, query = registry()

_W = r"\p{L}\p{N}_"
_ONES = "[" + ", ".join(f"'{w}'" for w in T.ONES) + "]"
_TENS = "[" + ", ".join(f"'{w}'" for w in T.TENS) + "]"


def words_sql(n: str) -> str:
    """Words of an INT expression from 0 to 9,999."""
    two = f"CASE WHEN {n} % 100 < 20 THEN {_ONES}[{n} % 100 + 1] ELSE {_TENS}[{n} % 100 // 10 - 1] || CASE WHEN {n} % 10 > 0 THEN '-' || {_ONES}[{n} % 10 + 1] ELSE '' END END"
    hundred = f"CASE WHEN {n} % 1000 >= 100 THEN {_ONES}[{n} % 1000 // 100 + 1] || ' hundred' END"
    return f"concat_ws(' ', CASE WHEN {n} >= 1000 THEN {_ONES}[{n} // 1000 + 1] || ' thousand' END, {hundred}, CASE WHEN {n} % 100 > 0 OR {n} = 0 THEN {two} END)"


def ordinal_sql(w: str) -> str:
    ends = [("y", "ieth"), ("one", "first"), ("two", "second"), ("three", "third"), ("five", "fifth"), ("eight", "eighth"), ("nine", "ninth"), ("twelve", "twelfth")]
    return "CASE " + " ".join(f"WHEN ends_with({w}, '{a}') THEN left({w}, length({w}) - {len(a)}) || '{b}'" for a, b in ends) + f" ELSE {w} || 'th' END"


def subs_sql(text: str, *pairs: tuple[str, str]) -> str:
    for pattern, said in pairs:
        text = f"regexp_replace({text}, '{pattern}', '{said}', 'g')"
    return text


def _docs(spark, d, step, plain: bool = False):
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs = S.with_plain_letters(docs) if plain else docs
    return docs.select("doc_id", step(F.col("text")).alias("body"))


@query("str4_straight_quotes", f"""SELECT doc_id, translate(text, '‘’‚‛“”„‟′″«»{S.INVERTED}{S.ZERO_WIDTH}', '''''''''\"\"\"\"''\"\"\"') AS body FROM documents""")
def quotes(spark, d):
    return _docs(spark, d, lambda t: F.translate(T.straight_quotes(t), S.INVERTED, ""))


@query("str5_normal_form", rf"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(nfc_normalize(translate(text, '{S.ZERO_WIDTH}', '')), '(?s)\P{{M}}\p{{M}}*'),
  lambda c: CASE WHEN length(c) > 1 OR c BETWEEN chr(7680) AND chr(7935) THEN strip_accents(left(c, 1)) ELSE c END), '') AS text FROM documents""")
def normal_form(spark, d):
    """NFC, Latin Extended Additional folded, stacked and lone marks out. ASCII texts never leave the JVM."""
    return S.with_plain_letters(table(spark, d, "documents").select("doc_id", "text"))


_EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]+"


@query("str6_latin_only", "SELECT doc_id, " + subs_sql("text", (_EMOJI, " "), (r"[^\P{L}\x{0}-\x{2AF}\x{1E00}-\x{1EFF}]", " ")) + " AS body FROM documents")
def latin_only(spark, d):
    """Letters outside the Latin blocks, and emoji, become spaces."""
    return _docs(spark, d, S.latin_only)


@query("str7_number_words", f"SELECT o_orderkey AS k, {words_sql('n')} AS words, {ordinal_sql(words_sql('n'))} AS ordinal FROM (SELECT o_orderkey, (o_orderkey % 10000)::INT AS n FROM orders)")
def number_words(spark, d):
    n = (F.col("o_orderkey") % 10000).cast("int")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), T.number_words(n).alias("words"), S.ordinal(n).alias("ordinal"))


_INT = "TRY_CAST(regexp_extract(x, '[0-9]+') AS INT)"
_FRACTION = f"array_to_string(list_transform(string_split(split_part(x, '.', 2), ''), lambda c: {_ONES}[TRY_CAST(c AS INT) + 1]), ' ')"


@query("str7_text_numbers", rf"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s)\$?[{_W}.]+|[^{_W}.$]+|\$'), lambda x: CASE
  WHEN regexp_matches(x, '^\$?[0-9]{{1,4}}\.[0-9]{{1,4}}$') THEN CASE WHEN starts_with(x, '$') THEN '$' ELSE '' END || {words_sql(_INT)} || ' point ' || {_FRACTION}
  WHEN regexp_matches(x, '(?i)^\$?[0-9]{{1,4}}(st|nd|rd|th)$') THEN CASE WHEN starts_with(x, '$') THEN '$' ELSE '' END || {ordinal_sql(words_sql(_INT))}
  WHEN regexp_matches(x, '^[0-9]{{1,4}}$') THEN {words_sql(_INT)} ELSE x END), '') AS body FROM documents""")
def text_numbers(spark, d):
    """Decimals, ordinals and integers of up to four digits, wherever they stand alone."""
    return _docs(spark, d, S.numbers)


_TWICE = [(r"([0-9])[-–]([0-9])", r"\1 to \2")] * 2


@query("str8_number_forms", "SELECT doc_id, " + subs_sql(
    "text", *[(r"([0-9]),([0-9]{3})($|[^0-9])", r"\1\2\3")] * 3, *_TWICE, *[(rf"#\s?([0-9]{{1,4}})($|[^{_W}])", r"number \1\2")] * 2, *[(r"([0-9])\s*\+\s*([0-9])", r"\1 plus \2")] * 2,
    *[(r"([0-9])\s*-\s*([0-9])", r"\1 minus \2")] * 2, (rf"(^|[^{_W}.])\+([0-9])", r"\1plus \2"), (rf"(^|[^{_W}.])-([0-9])", r"\1minus \2"),
) + " AS body FROM documents")
def number_forms(spark, d):
    """Thousands separators, ranges, hash numbers, arithmetic and leading signs."""
    return _docs(spark, d, lambda t: S.signs(S.number_marks(t)))


_WORD = rf"(?i)(^|[^{_W}])"


@query("str9_symbols", "SELECT doc_id, " + subs_sql(
    "text", (_WORD + r"e\.g\.", r"\1for example"), (_WORD + r"i\.e\.", r"\1that is"), (_WORD + r"etc\.(\s|$)", r"\1et cetera\2"), (_WORD + r"vs\.?(\s|$)", r"\1versus\2"), (_WORD + rf"w/o($|[^{_W}])", r"\1without\2"),
    (_WORD + rf"w/([{_W}])", r"\1with\2"), (_WORD + r"a\.m\.", r"\1 AM"), (_WORD + r"p\.m\.", r"\1 PM"), (r"\s*&\s*", " and "), (r"([0-9])\s*%", r"\1 percent"), (r"([0-9])\s*°", r"\1 degrees"),
) + " AS body FROM documents")
def symbols(spark, d):
    return _docs(spark, d, S.symbols)


@query("str10_star_ratings", "SELECT doc_id, " + subs_sql(
    rf"array_to_string(list_transform(regexp_extract_all(text, '(?s)[{_W}*]+|[^{_W}*]+'), lambda x: CASE WHEN regexp_matches(x, '^[*][*]+$') THEN ' ' || length(x) || ' stars ' ELSE x END), '')",
    (rf"(?i)(^|[^{_W}*])(1|one)\s?\*($|[^{_W}*])", r"\1\2 star\3"), (rf"(?i)(^|[^{_W}*])([0-9]+|one|two|three|four|five|six|seven|eight|nine|ten)\s?\*($|[^{_W}*])", r"\1\2 stars\3"), (rf":\s\*($|[^{_W}*])", r": 1 star\1"),
) + " AS body FROM documents")
def star_ratings(spark, d):
    """Ratings in stars; stars at a word are none."""
    return _docs(spark, d, S.stars)


@query("str11_ranks")
def rank_words(spark, d):
    """Abbreviated ranks in words; literal cases prove it, as the texts hold few."""
    return _docs(spark, d, S.ranks)


@query("str12_romans", f"""SELECT o_orderkey, CASE WHEN n BETWEEN 1 AND 39 THEN n END AS value, CASE WHEN n = 38 THEN 'Class XXXVIII, part (XXXVIII)' WHEN n BETWEEN 1 AND 39 THEN 'Class ' || w || ', part (' || w || ')' WHEN n = 0 THEN 'Class , part ()' ELSE 'Class XL, part (XL)' END AS said
FROM (SELECT o_orderkey, n, {words_sql('n')} AS w FROM (SELECT o_orderkey, (o_orderkey % 45)::INT AS n FROM orders))""")
def romans(spark, d):
    """Canonical numerals from 1 to 39; after a label or in parentheses those of up to six letters are said."""
    n = (F.col("o_orderkey") % 45).cast("int")
    ones = F.array(*[F.lit(x) for x in ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]])
    token = F.when(n >= 40, F.lit("XL")).otherwise(F.concat(F.repeat(F.lit("X"), F.floor(n / 10).cast("int")), F.get(ones, n % 10)))
    text = F.concat(F.lit("Class "), token, F.lit(", part ("), token, F.lit(")"))
    return table(spark, d, "orders").select("o_orderkey", T.roman_value(token).alias("value"), S.romans(text).alias("said"))


_ARROW = r"\s*(?:->|=>|→|➔|➜)\s*"


@query("str13_punctuation", "SELECT doc_id, trim(" + subs_sql(
    "replace(replace(replace(" + subs_sql(
        "text", (r"([0-9])\s*~\s*([0-9])", r"\1 to \2"), (rf"(^|[^{_W}~])~\s*([0-9])", r"\1about \2"), (rf"([{_W}])~+(\s+[{_W}])", r"\1,\2"), (r"\s*~+", ""), (_ARROW + r"\z", ""), (_ARROW, " to "),
        (rf"(^|[^{_W}])([A-Za-z]{{3,}}c)-y($|[^{_W}-])", r"\1\2ky\3"), (rf"(^|[^{_W}])([A-Za-z]{{3,}})-y($|[^{_W}-])", r"\1\2y\3"), (r"(^|[^*])\*([^*\n]+)\*($|[^*])", r"\1\2\3"), (r"\.\s\.\s\.", "…"), (r"\.\.\.", "…"),
    ) + ", '—', ' — '), '–', ' – '), '--', ' — ')", (r"[ \t\n\r]+", " "), (" +([,.;:!?])", r"\1"),
) + ") AS body FROM documents")
def punctuation(spark, d):
    """Drawn-out marks, arrows, a hyphenated -y, italics, ellipses, dashes, white space, and no space before punctuation."""
    return _docs(spark, d, lambda t: S.tidy(S.dashes(S.ellipses(S.without_italics(S.joined_y(S.arrows(S.tildes(t))))))))


@query("str14_stat_lines", f"SELECT o_orderkey, 'hit points: ' || {words_sql('(o_orderkey % 100)::INT')} || ' out of one hundred, Strength equals ' || {words_sql('(o_orderkey % 30)::INT')} || ', five' AS said FROM orders")
def stat_lines(spark, d):
    k = F.col("o_orderkey")
    line = F.concat(F.lit("[HP: "), (k % 100).cast("string"), F.lit("/100, STR = "), (k % 30).cast("string"), F.lit("|5]"))
    return table(spark, d, "orders").select("o_orderkey", S.stat_line(line).alias("said"))


@query("str16_headings", f"""SELECT source_id, 'Chapter ' || upper(left(w, 1)) || substr(w, 2) || CASE source_id % 3 WHEN 2 THEN '' ELSE '. ' || {_ONES}[left(p, 1)::INT + 1] || substr(p, 2) END AS heading
FROM (SELECT o_orderkey AS source_id, o_orderpriority AS p, {words_sql('(o_orderkey % 1000)::INT')} AS w FROM orders)""")
def headings(spark, d):
    """A leading number becomes "Chapter N." in words, and the title takes the pass."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    n = (k % 1000).cast("string")
    t = F.when(k % 3 == 0, F.concat(F.lit("Ch. "), n, F.lit(": "), p)).when(k % 3 == 1, F.concat(n, F.lit("- "), p, F.lit(" -"))).otherwise(F.concat(F.lit("CHAPTER "), n))
    return table(spark, d, "orders").select(k.alias("source_id"), S.heading(t).alias("heading"))


@query("str17_handles", f"""SELECT c_custkey, 'Forever ' || CASE WHEN c_custkey < 10000 THEN {ordinal_sql(words_sql('c_custkey::INT'))} ELSE c_custkey || ' st' END || ' Fan' || CASE WHEN c_custkey % 2 = 0 THEN ' x' ELSE '' END AS said FROM customer""")
def handles(spark, d):
    """Handles in words: camel case, letters against digits, separators, numbers."""
    h = F.concat(F.lit("@Forever"), F.col("c_custkey").cast("string"), F.lit("stFan"), F.when(F.col("c_custkey") % 2 == 0, "_x:").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", S.handle(h).alias("said"))


_CORE = "regexp_replace(regexp_replace(x, '^[{e}]+', ''), '[{e}]+$', '')".format(e=S.EDGES.replace("'", "''", 1))


@query("win14_damp_capitals", rf"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '(?s)\s+|\S+') AS ts FROM documents),
f AS (SELECT doc_id, text, ts, list_transform(ts, lambda x: CASE WHEN regexp_matches({_CORE}, '^[A-Z][A-Z''’-]*[A-Z]$') AND NOT regexp_matches({_CORE}, '^[IVXLCDM]+$') THEN length({_CORE}) ELSE 0 END) AS ns FROM t)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(list_transform(range(1, len(ts) + 1), lambda i: CASE WHEN ns[i] > 0 AND (ns[i] <= 2 OR (i > 2 AND ns[i - 2] > 0) OR coalesce(ns[i + 2], 0) > 0) THEN lower(ts[i]) ELSE ts[i] END), '') END AS body FROM f""")
def damp_capitals(spark, d):
    """Shouted words are lowered when short or beside another."""
    return _docs(spark, d, S.damped_capitals)


@query("spoken_form")
def spoken_form(spark, d):
    """The whole pass over each chapter; each step has a query with a twin, the order of steps has literal cases."""
    return _docs(spark, d, S.spoken, plain=True)
