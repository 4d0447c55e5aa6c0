"""The spoken form of a text as a chain of column expressions.

Each step is a function of one column and is skipped for texts without a character that it looks for. A step whose
replacement is computed (numbers, ranks, numerals) fences its matches with a mark, splits the text there and says
every second piece. Only texts beyond ASCII leave the JVM, for Unicode normal forms, in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialmill.functions import text as T
from serialmill.session import ship_code

CUT, PART = "\u0001", "\u0002"
_W = r"\p{L}\p{N}_"  # characters of a word
_B, _E = rf"(?<![{_W}])", rf"(?![{_W}])"  # no such character before, or after

# Characters that take no room, and marks before a question or an exclamation.
ZERO_WIDTH = "​‌‍⁠﻿"
INVERTED = "¿¡"


# --- letters


def _combining() -> str:
    """A character class of all combining marks."""
    codes = [c for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))]
    spans, start = [], None
    for c, after in zip(codes, [*codes[1:], -1], strict=True):
        start = c if start is None else start
        if after != c + 1:
            spans.append(f"{chr(start)}-{chr(c)}")
            start = None
    return "".join(spans)


_MARKED = re.compile(f"([^{(_m := _combining())}]?)[{_m}]+", re.S)
#: Latin Extended Additional letters without their marks; two have no decomposition.
_FOLDED = {c: "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x)) for c in range(0x1E00, 0x1F00)} | {0x1E9E: "SS", 0x1E9B: "s"}
_NO_ROOM = dict.fromkeys(map(ord, ZERO_WIDTH))


_BEYOND_ASCII = re.compile(r"[^\x00-\x7F]+")
_ANY_MARK = re.compile(f"[{_m}]")


def _settled(m: re.Match) -> str:
    whole = unicodedata.normalize("NFC", m[0])
    return "" if not m[1] else whole if len(whole) == 1 else m[1]


def _plain_run(s: str) -> str:
    s = unicodedata.normalize("NFD", unicodedata.normalize("NFC", s).translate(_NO_ROOM).translate(_FOLDED))
    return _MARKED.sub(_settled, s) if _ANY_MARK.search(s) else s


_short_run = lru_cache(1 << 16)(lambda s: _plain_run(s))  # an accented letter and the one before it come again and again


def plain_letters(s: str | None) -> str | None:
    """NFC; letters of Latin Extended Additional lose their marks; a letter under more marks than make one character loses all of them; lone marks go.
    ASCII takes part only as the letter before a run of other characters, so no more of it is looked at."""
    if s is None or s.isascii():
        return s
    out, at = [], 0
    for m in _BEYOND_ASCII.finditer(s):
        start = max(m.start() - 1, 0)
        out += [s[at:start], _short_run(run) if len(run := s[start : m.end()]) <= 8 else _plain_run(run)]
        at = m.end()
    return "".join([*out, s[at:]])


def with_plain_letters(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``plain_letters`` of a column; ASCII texts and nulls never leave the JVM."""
    ship_code(df.sparkSession)

    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.map(plain_letters)

    wide = F.coalesce(F.col(text).rlike(r"[^\x00-\x7F]"), F.lit(False))
    return df.where(~wide).unionByName(df.where(wide).withColumn(text, plain(text)))


def latin_only(t: Column) -> Column:
    """Emoji and letters of other scripts become spaces; neither is in a text of the Latin blocks alone."""
    emoji = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]+"
    beyond = r"[^\x{0}-\x{2AF}\x{1E00}-\x{1EFF}]"
    return when_has(t, beyond, lambda x: F.regexp_replace(F.regexp_replace(x, emoji, " "), rf"[{beyond}&&\p{{L}}]", " "))


# --- helpers


def when_has(t: Column, pattern: str, step: Callable[[Column], Column]) -> Column:
    """``step`` of texts that hold the pattern. The text is bound once, so a chain of steps grows by a term a step."""
    return T.bound(t, lambda x: F.when(x.rlike(pattern), step(x)).otherwise(x))


#: Looked at first, as one range is cheaper than a class of many characters.
_RARE = r"(?=[\x01\x02\x{80}-\x{FFFF}])"


def without(t: Column, chars: str) -> Column:
    return when_has(t, f"{_RARE}[{chars}]", lambda x: F.translate(x, chars, ""))


def _subs(t: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, said in pairs:
        t = F.regexp_replace(t, pattern, said)
    return t


def each_match(t: Column, pattern: str, keep: str, said: Callable[[Column], Column]) -> Column:
    """Every match replaced by ``said`` of what ``keep`` (groups, apart by PART) names of it."""
    pieces = F.split(F.regexp_replace(t, pattern, CUT + keep + CUT), CUT, -1)
    return F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, said(x)).otherwise(x)), "")


def _part(x: Column, i: int) -> Column:
    return F.get(F.split(x, PART, -1), F.lit(i))


def _number(x: Column) -> Column:
    return T.number_words(x.cast("int"))


def ordinal(x: Column) -> Column:
    """first, second, ... of digits; the last word of the number changes."""
    ends = [("one", "first"), ("two", "second"), ("three", "third"), ("five", "fifth"), ("eight", "eighth"), ("nine", "ninth"), ("twelve", "twelfth")]

    def said(w: Column) -> Column:
        out = F.when(w.endswith("y"), F.regexp_replace(w, "y$", "ieth"))
        for a, b in ends:
            out = out.when(w.endswith(a), F.regexp_replace(w, f"{a}$", b))
        return out.otherwise(F.concat(w, F.lit("th")))

    return T.bound(_number(x), said)


# --- steps


def tildes(t: Column) -> Column:
    """A range between numbers, "about" before one, else a drawn-out word: a pause where a word follows."""
    return when_has(t, "~", lambda x: _subs(x, (r"(?<=\d)\s*~\s*(?=\d)", " to "), (rf"(?<![{_W}~])~\s*(?=\d)", "about "), (rf"(?<=[{_W}])~+(?=\s+[{_W}])", ","), (r"\s*~+", "")))


def arrows(t: Column) -> Column:
    arrow = r"\s*(?:->|=>|→|➔|➜)\s*"
    return when_has(t, "[-=]>|[→➔➜]", lambda x: _subs(x, (arrow + r"\z", ""), (arrow, " to ")))


_COUNTS = "one two three four five six seven eight nine ten".split()


def stars(t: Column) -> Column:
    """Runs of stars that stand alone, and counted ones, are ratings; stars at a word are not."""
    alone = rf"(?![{_W}*])"
    runs = lambda x: each_match(x, rf"(?<![{_W}*])(\*{{2,}}){alone}", "$1", lambda r: F.concat(F.lit(" "), F.length(r).cast("string"), F.lit(" stars ")))
    counted = lambda x: _subs(x, (rf"(?i)(?<![{_W}*])(1|one)\s?\*{alone}", "$1 star"), (rf"(?i)(?<![{_W}*])(\d+|{'|'.join(_COUNTS)})\s?\*{alone}", "$1 stars"), (rf"(?<=:)\s\*{alone}", " 1 star"))
    return when_has(t, r"\*", lambda x: counted(runs(x)))


# Ranks by their abbreviations, and those that are also words or names and so need their period.
RANKS = {
    "LTJG": "lieutenant junior grade", "LCDR": "lieutenant commander", "LCdr": "lieutenant commander", "LTC": "lieutenant colonel", "LtCol": "lieutenant colonel", "LTCOL": "lieutenant colonel",
    "MCPO": "master chief petty officer", "CPO": "chief petty officer", "RADM": "rear admiral", "VADM": "vice admiral", "SSgt": "staff sergeant", "SSG": "staff sergeant", "SFC": "sergeant first class",
    "MSG": "master sergeant", "SGM": "sergeant major", "PFC": "private first class", "SPC": "specialist", "CPT": "captain", "CAPT": "captain", "Capt": "captain", "SGT": "sergeant", "Sgt": "sergeant",
    "CDR": "commander", "Cdr": "commander", "Cpl": "corporal", "Pvt": "private", "Maj": "major", "Midn": "midshipman", "Ens": "ensign", "ENS": "ensign", "Adm": "admiral", "Col": "colonel",
    "Gen": "general", "Lt": "lieutenant",
}
WITH_PERIOD = ("Col", "Gen", "Adm", "Ens")
_NAME_NEXT = r"(?=\s+[A-Z][a-z])"


def ranks(t: Column) -> Column:
    """Abbreviated ranks in words, where a period or a name follows."""
    graded = [(rf"(?<![{_W}.]){n}(?:st|nd|d)?\s?(?:{short}){_E}\.?", f"{word} {said}") for n, word in (("1", "first"), ("2", "second")) for short, said in (("Lt|LT", "lieutenant"), ("Sgt|SGT|SG", "sergeant"))]
    petty = [(rf"{_B}PO{n}{_E}", f"petty officer {word} class") for n, word in (("1", "first"), ("2", "second"), ("3", "third"))]
    colonel = (rf"(?<![{_W}.])Lt\.? ?Col(?:\.|{_NAME_NEXT}){_E}", "lieutenant colonel")
    table = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    said = lambda x: F.when((_part(x, 1) == "") & _part(x, 0).isin(*WITH_PERIOD), _part(x, 0)).otherwise(F.element_at(table, _part(x, 0)))
    longest = "|".join(sorted(RANKS, key=len, reverse=True))
    whole = lambda x: each_match(_subs(x, *graded, *petty, (rf"(?<![{_W}.])LT{_NAME_NEXT}", "lieutenant"), colonel), rf"(?<![{_W}.])({longest})(\.|{_NAME_NEXT}){_E}", f"$1{PART}$2", said)
    first = "".join(sorted({r[0] for r in RANKS}))  # looked at before anything else: few characters of a text are one of these
    return when_has(t, rf"(?=[12P{first}]){_B}(?:[12](?:st|nd|d)?\s?(?:L[tT]|S)|PO[123]|LT|{longest})", whole)


def romans(t: Column) -> Column:
    """Canonical numerals of 1 to 39 after a label or alone in parentheses; a lone I needs a label with a capital."""

    def labelled(x: Column) -> Column:
        before, numeral, hyphen = (_part(x, i) for i in range(3))
        said = lambda v: F.concat(before, T.number_words(v), F.when(hyphen != "", " ").otherwise(""))
        return T.bound(T.roman_value(numeral), lambda v: F.when(v.isNull() | ((v == 1) & ~before.rlike("^[A-Z]")), F.concat(before, numeral, hyphen)).otherwise(said(v)))

    label = rf"{_B}((?:[Mm]ark|[Mm]odel|[Cc]lass|[Ll]evel|[Cc]hapter)\s+)([IVX]{{1,6}})(-(?=[A-Z]{_E})|(?![{_W}'’]))"
    paren = lambda x: F.concat(F.lit("("), F.coalesce(T.number_words(T.roman_value(x)), x), F.lit(")"))
    whole = lambda x: each_match(each_match(x, label, f"$1{PART}$2{PART}$3", labelled), r"\(([IVX]{1,6})\)", "$1", paren)
    return when_has(t, r"(?=[\s(])(?:\([IVX]+\)|(?=\s+[IVX])(?<=ark|odel|lass|evel|hapter))", whole)


def joined_y(t: Column) -> Column:
    """A hyphenated -y joins its word; after c it takes a k."""
    return when_has(t, "-y", lambda x: _subs(x, (rf"{_B}([A-Za-z]{{3,}}c)-y(?![{_W}-])", "$1ky"), (rf"{_B}([A-Za-z]{{3,}})-y(?![{_W}-])", "$1y")))


def without_italics(t: Column) -> Column:
    return when_has(t, r"\*", lambda x: F.regexp_replace(x, r"(?<!\*)\*(?!\*)([^*\n]+?)\*(?!\*)", "$1"))


# Fixed value: punctuation around a word.
EDGES = "\"'’“”‘()\\[\\].,!?;:…—–*"


def damped_capitals(t: Column) -> Column:
    """Shouted words are lowered when short or beside another; neighbours are judged on the text as it was. Numerals are no shouts."""
    core = lambda x: F.regexp_replace(x, f"^[{EDGES}]+|[{EDGES}]+$", "")
    loud = lambda c: c.rlike(r"^[A-Z][A-Z'’-]*[A-Z]$") & ~c.rlike("^[IVXLCDM]+$")
    token = lambda w: T.bound(core(w), lambda c: F.struct(w.alias("w"), F.when(loud(c), F.length(c)).otherwise(0).alias("n")))
    near = lambda a, i: F.coalesce(F.get(a, i)["n"] > 0, F.lit(False))

    def whole(x: Column) -> Column:
        tokens = F.transform(F.split(x, r"(?<=\S)(?=\s)|(?<=\s)(?=\S)", -1), token)  # words and the spaces between them
        lowered = lambda a: F.transform(a, lambda x, i: F.when((x["n"] > 0) & ((x["n"] <= 2) | near(a, i - 2) | near(a, i + 2)), F.lower(x["w"])).otherwise(x["w"]))
        return F.array_join(T.bound(tokens, lowered), "")

    return when_has(t, "[A-Z]['’-]*[A-Z]", whole)


def ellipses(t: Column) -> Column:
    return when_has(t, r"\.\s?\.", lambda x: F.replace(F.regexp_replace(x, r"\.\s\.\s\.", "…"), F.lit("..."), F.lit("…")))


def number_marks(t: Column) -> Column:
    """Thousands separators go; a tight dash between digits is a range."""
    return when_has(t, "[0-9]", lambda x: _subs(x, (r"(?<=[0-9]),(?=[0-9]{3}(?:[^0-9]|$))", ""), ("(?<=[0-9])[-–](?=[0-9])", " to ")))


def dashes(t: Column) -> Column:
    return when_has(t, "[—–]|--", lambda x: F.replace(F.replace(F.replace(x, F.lit("—"), F.lit(" — ")), F.lit("–"), F.lit(" – ")), F.lit("--"), F.lit(" — ")))


# Abbreviations and symbols with what is said for them, in order; each after what a text must hold for it.
SAID = [
    (r"[eE]\.[gG]\.", rf"(?i){_B}e\.g\.", "for example"), (r"[iI]\.[eE]\.", rf"(?i){_B}i\.e\.", "that is"), (r"[eE][tT][cC]\.", rf"(?i){_B}etc\.(?=\s|$)", "et cetera"),
    (r"[vV][sS](?:\.|\s|$)", rf"(?i){_B}vs\.?(?=\s|$)", "versus"), ("[wW]/[oO]", rf"(?i){_B}w/o{_E}", "without"), ("[wW]/", rf"(?i){_B}w/(?=[{_W}])", "with"),
    (r"[aA]\.[mM]\.", rf"(?i){_B}a\.m\.", " AM"), (r"[pP]\.[mM]\.", rf"(?i){_B}p\.m\.", " PM"), ("&", r"\s*&\s*", " and "), ("%", r"(?<=[0-9])\s*%", " percent"), ("°", r"(?<=[0-9])\s*°", " degrees"),
]


def symbols(t: Column) -> Column:
    def each(x: Column) -> Column:
        for has, pattern, said in SAID:
            x = when_has(x, has, lambda x, pattern=pattern, said=said: F.regexp_replace(x, pattern, said))
        return x

    return when_has(t, r"(?=[&%°/.cCvV])(?:[&%°/]|\.[gGeEmM]\.|[cC]\.|[vV][sS](?:\.|\s|$))", each)


def signs(t: Column) -> Column:
    """Hash numbers, arithmetic between digits and leading signs; digits stay for the next step."""
    pairs = [(rf"#\s?([0-9]{{1,4}}){_E}", "number $1"), (r"(?<=[0-9])\s*\+\s*(?=[0-9])", " plus "), (r"(?<=[0-9])\s*-\s*(?=[0-9])", " minus "), (rf"(?<![{_W}.])\+(?=[0-9])", "plus "), (rf"(?<![{_W}.])-(?=[0-9])", "minus ")]
    return when_has(t, "[#+-]", lambda x: _subs(x, *pairs))


def levels(t: Column) -> Column:
    return when_has(t, "(?i)lvl", lambda x: F.regexp_replace(x, rf"(?i){_B}lvl{_E}\.?", "level"))


def numbers(t: Column) -> Column:
    """Decimals, ordinals and integers of up to four digits in words."""
    free, end = rf"(?<![{_W}.])", rf"(?![{_W}.])"
    digits = lambda x: F.array_join(F.transform(F.filter(F.split(x, ""), lambda c: c != ""), _number), " ")
    decimals = lambda x: each_match(x, rf"{free}([0-9]{{1,4}})\.([0-9]{{1,4}}){end}", f"$1{PART}$2", lambda x: F.concat(_number(_part(x, 0)), F.lit(" point "), digits(_part(x, 1))))
    ordinals = lambda x: each_match(x, rf"(?i){_B}([0-9]{{1,4}})(?:st|nd|rd|th){_E}", "$1", ordinal)
    return when_has(t, "[0-9]", lambda x: each_match(ordinals(decimals(x)), rf"(?<![{_W}$.])([0-9]{{1,4}}){end}", "$1", _number))


def tidy(t: Column) -> Column:
    """White space to single spaces, none before punctuation. A space by itself, as most are, is no match."""
    single = F.regexp_replace(t, r"[\t\n\r][ \t\n\r]*+| [ \t\n\r]++", " ")
    return F.trim(F.regexp_replace(single, " +([,.;:!?])", "$1"))


#: Characters that some step other than those of words looks for; beyond the Latin blocks any character is one.
MARKS = r"[\x01\x02~>*\-0-9#+¡¿«»]"


def has_marks(t: Column) -> Column:
    return t.rlike(MARKS) | ((F.octet_length(t) != F.length(t)) & t.rlike(r"[\x{2B0}-\x{10FFFF}]"))


def spoken(t: Column, damp: bool = True) -> Column:
    """The whole pass over a text whose letters are plain (``with_plain_letters``)."""
    curly = lambda x: when_has(x, f"{_RARE}[{T.CURLY}]", T.straight_quotes)
    lowered = [damped_capitals] if damp else []
    words = [ranks, romans, *lowered, ellipses, symbols, levels, tidy]
    every = [lambda x: without(x, ZERO_WIDTH + CUT + PART), tildes, arrows, latin_only, lambda x: without(x, INVERTED), curly, stars, ranks, romans, joined_y, without_italics]
    every += [*lowered, ellipses, number_marks, dashes, symbols, signs, levels, numbers, tidy]

    def chain(x: Column, steps: list[Callable[[Column], Column]]) -> Column:
        for step in steps:
            x = step(x)
        return x

    return T.bound(t, lambda x: F.when(has_marks(x), chain(x, every)).otherwise(chain(x, words)))


def stat_line(t: Column) -> Column:
    """STR14: what a stat box adds before the pass: pairs and ratios, unknown values, signs, abbreviations; acronyms keep their capitals."""
    t = F.translate(arrows(t), CUT + PART, "")
    mark = rf"\s*(?<![{_W}?])\?{{3,}}(?![{_W}?])"
    t = _subs(t, (r"([0-9])\s*\|\s*(?=[0-9])", "$1, "), (r"[\[\]]", " "), (rf"(?:^|(?<=[(\[])){mark}", "unknown"), (mark, " unknown"), (r"\(\+\)", " plus"), (r"\(-\)", " minus"), (r"\s=\s", " equals "), *T.STAT_WORDS)
    at = lambda x, i: _number(_part(x, i))
    t = each_match(t, rf"{_B}([0-9]{{1,5}})\s*/\s*([0-9]{{1,5}}){_E}", f"$1{PART}$2", lambda x: F.concat(at(x, 0), F.lit(" out of "), at(x, 1)))
    return spoken(F.regexp_replace(t, "(?<=[a-z])%", " percent"), damp=False)


HEADING = r"(?is)^\s*(?:chapter\s+|ch\.?\s*)?([0-9]{1,4})\s*[.\-:)\]]*\s*(.*)$"


def heading(t: Column) -> Column:
    """STR16: a leading number becomes "Chapter N." with its number in words."""
    n = _number(F.regexp_extract(t, HEADING, 1))
    rest = F.regexp_replace(F.regexp_extract(t, HEADING, 2), r"^[ .:\-–—]+|[ .:\-–—]+$", "")
    capital = T.bound(n, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 200)))
    said = F.concat(F.lit("Chapter "), capital, F.when(rest != "", F.concat(F.lit(". "), rest)).otherwise(""))
    return spoken(F.when(t.rlike(HEADING), said).otherwise(t))


def handle(t: Column) -> Column:
    """STR17: a handle in words, its numbers too."""
    return T.bound(spoken(T.spoken_handle(t)), lambda said: F.when(said != "", said).otherwise(F.trim(t)))


def chat_message(t: Column) -> Column:
    """STR17: brackets and the at signs of mentions go, long shouts get one capital, then the pass."""
    t = F.translate(F.trim(F.regexp_replace(t, r"^\[+|\]+$", "")), CUT + PART, "")
    t = F.regexp_replace(t, rf"(?<![{_W}])@(?=[{_W}])", "")
    return spoken(each_match(t, rf"{_B}([A-Z][A-Z'’]{{3,}}){_E}", "$1", lambda x: F.concat(F.left(x, F.lit(1)), F.lower(F.substring(x, 2, 1000)))))
