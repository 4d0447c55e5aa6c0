"""Literal cases of the spoken form, all in one job a function."""

import random

from pyspark.sql import functions as F

from serialmill.functions import spoken as S

CASES = {
    "“Hi,” he said’s": '"Hi," he said\'s',
    "reached Lvl 5": "reached level five",
    "the 3 knights": "the three knights",
    "1,200 soldiers": "one thousand two hundred soldiers",
    "his 70th level": "his seventieth level",
    "the 3rd example, the 12th and 21ST": "the third example, the twelfth and twenty-first",
    "wo\u200brd": "word",
    "it hit 2.5 times": "it hit two point five times",
    "down 50% now": "down fifty percent now",
    "weapons e.g. swords": "weapons for example swords",
    "wait . . . what": "wait … what",
    "HP is 20 & rising": "hp is twenty and rising",
    "He said 你好 to me, Kevin?": "He said to me, Kevin?",
    "The word Привет appeared.": "The word appeared.",
    "¡Hola! ¿Cómo estás?": "Hola! Cómo estás?",
    "Renée met señor Núñez. Nǐ hǎo, Li?": "Renée met señor Núñez. Nǐ hǎo, Li?",
    '"DAMN IT!"': '"damn it!"',
    "Help US, please.": "Help us, please.",
    "GET OUT OF MY HOUSE.": "get out of my house.",
    "I said IT, not US.": "I said it, not us.",
    "The FBI called about a USB drive.": "The FBI called about a USB drive.",
    "Chapter IV: The Return": "Chapter four: The Return",
    "pages 1-4": "pages one to four",
    "1–4 days": "one to four days",
    "a 10-15% gain": "a ten to fifteen percent gain",
    "1,000-2,000 men": "one thousand to two thousand men",
    "rank 3-4-5": "rank three to four to five",
    "he lost 5 - 3": "he lost five minus three",
    "a 10-year-old": "a ten-year-old",
    "Strength +2, Speed -1": "Strength plus two, Speed minus one",
    "-4 degrees": "minus four degrees",
    '"Oh, Disciple~"': '"Oh, Disciple"',
    "Thank you~ for coming~!": "Thank you, for coming!",
    "Ah~ no, no, I never would,": "Ah, no, no, I never would,",
    "Down the mountain now I go~~": "Down the mountain now I go",
    "~": "",
    "about 5~10 days": "about five to ten days",
    "~100 of them": "about one hundred of them",
    "barred from entering Saṃsāra.": "barred from entering Samsāra.",
    "Kṛṣṇa and Śiva": "Krsna and Śiva",
    "Đà Nẵng": "Đà Nang",
    "Straẞe": "StraSSe",
    "Xiāo café Brontë résumé Łódź naïve": "Xiāo café Brontë résumé Łódź naïve",
    "cafe\u0301": "café",
    "W\u0334\u0353h\u0337a\u0334\u0317t\u0337": "What",
    "\u0337\u0328": "",
    "Offense: ***** Defense: *** Speed: * Regeneration: ****": "Offense: five stars Defense: three stars Speed: one star Regeneration: four stars",
    "A 1 * increase. Limit: 2 *, Maximum 5* Rating.": "A one star increase. Limit: two stars, Maximum five stars Rating.",
    "*Why?* she asked": "Why? she asked",
    "What the f*** was that": "What the f*** was that",
    "2LT Hale saluted.": "second lieutenant Hale saluted.",
    "2nd Lt. Hale and 1st Lt. Ross": "second lieutenant Hale and first lieutenant Ross",
    "Capt. Voss, Sgt. Pike, Cpl Dune": "captain Voss, sergeant Pike, corporal Dune",
    "LTC Marsh, Lt. Col. Ames, LtCol Bo": "lieutenant colonel Marsh, lieutenant colonel Ames, lieutenant colonel Bo",
    "SSgt Roe and 1SG Tan": "staff sergeant Roe and first sergeant Tan",
    "PO2 Reyes": "petty officer second class Reyes",
    "Col. Sanders": "colonel Sanders",
    "Col Sanders, the col of data, He is a Major.": "Col Sanders, the col of data, He is a Major.",
    "a Class I, Class II and Class V threat": "a Class one, Class two and Class five threat",
    "Mark IV, level II, Chapter IX": "Mark four, level two, Chapter nine",
    "Mark I-D, Model III-D": "Mark one D, Model three D",
    "Class I--catalogues": "Class one — catalogues",
    "Dread and Quiet (VII)": "Dread and Quiet (seven)",
    "Part (XXVII)": "Part (twenty-seven)",
    "Might I suggest it, the class I joined, (IIII)": "Might I suggest it, the class I joined, (IIII)",
    "plastic-y and same-y, not a-y-b": "plasticky and samey, not a-y-b",
    "East -> West ->": "East to West",
    "w/o it, w/it, cats vs. dogs etc. at 5 a.m.": "without it, withit, cats versus dogs et cetera at five AM",
    "#12 and x#7": "number twelve and xnumber seven",
    "a\u0001b": "ab",
}
STATS = {
    "HP: 40/50  STR: 12  [Skill] -> [Power]": "hit points: forty out of fifty Strength: twelve Skill to Power",
    "DR: 5  Block: 10": "DR: five Block: ten",
    "6|30": "six, thirty",
    "Jade -> ???": "Jade to unknown",
    "??? (???)": "unknown (unknown)",
    "Jade(+) x = 3": "Jade plus x equals three",
    "99999/99999": "ninety-nine thousand nine hundred ninety-nine out of ninety-nine thousand nine hundred ninety-nine",
}
HEADS = {"1- Blade Of Old": "Chapter One. Blade Of Old", "Chapter 12: The Return": "Chapter Twelve. The Return", "Prologue": "Prologue", "ch. 21": "Chapter Twenty-one"}
HANDLES = {"Forever1stCommenter": "Forever first Commenter", "???": "unknown", "dark_lord-9": "dark lord nine", "@A": "A"}
CHATS = {"[@Bob NOOOO way!]": "Bob Noooo way!", "hello": "hello"}


def run(spark, cases, f):
    df = S.with_plain_letters(spark.createDataFrame([(k, k) for k in cases], "k string, text string"))
    got = {r[0]: r[1] for r in df.select("k", f(F.col("text"))).collect()}
    assert {k: (got[k], v) for k, v in cases.items() if got[k] != v} == {}


def test_spoken(spark):
    run(spark, CASES, S.spoken)


def test_stat_lines(spark):
    run(spark, STATS, S.stat_line)


def test_headings(spark):
    run(spark, HEADS, S.heading)


def test_handles(spark):
    run(spark, HANDLES, S.handle)


def test_chat(spark):
    run(spark, CHATS, S.chat_message)


def test_nulls_and_empty(spark):
    df = S.with_plain_letters(spark.createDataFrame([(1, None), (2, ""), (3, "é" * 3000)], "k int, text string"))
    assert sorted((r[0], r[1]) for r in df.select("k", S.spoken(F.col("text"))).collect()) == [(1, None), (2, ""), (3, "é" * 3000)]


def test_letters_are_settled_by_runs():
    """Runs beyond ASCII, each with the letter before it, give what the whole text gives."""
    parts = ["a", " ", "é", "́", "​", "ạ", "Straẞe", "한", "你好", "̷̨", "x​́", "Å", "ﬁ", "\n", "é"]
    r = random.Random(7)
    for _ in range(2000):
        s = "".join(r.choices(parts, k=r.randint(1, 12)))
        assert S.plain_letters(s) == ("".join(s) if s.isascii() else S._plain_run(s))


def test_plain_letters_looks_at_no_more_than_it_must(monkeypatch):
    seen = []
    S._short_run.cache_clear()
    monkeypatch.setattr(S, "_plain_run", lambda s: seen.append(s) or s)
    S.plain_letters("plain words " * 1000 + "café and more " + "words " * 1000)
    S._short_run.cache_clear()
    assert seen == ["fé"]


def test_prose_takes_the_steps_of_words_only(spark):
    """A text without marks and the same text behind one, which takes every step, are said alike."""
    prose = ["Capt. Voss said . . . no", "Mark IV (VII) etc. at  five a.m.\n\tI said IT, vs. Bob ,now", "Lvl up. Renée e.g. LT Hale", "GET OUT NOW. The FBI...", ""]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(prose)], "k int, text string")
    got = {r[0]: (r[1], r[2]) for r in df.select("k", S.spoken(F.col("text")), S.spoken(F.concat(F.lit("~"), F.col("text")))).collect()}
    assert {k: a for k, (a, b) in got.items() if a != b} == {}
    plan = df.select(S.spoken(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and S.MARKS in plan
