"""User functions that Spark has no built-in for: phonemes of words, tags of tokens. Each is passed in and called in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialmill.session import ship_code


def phoneme_table(words: DataFrame, phonemize: Callable[[str], str], word: str = "word") -> DataFrame:
    """UDF2: (word, phonemes), each distinct word phonemized once."""
    said = F.pandas_udf(lambda s: s.map(phonemize), "string")
    return words.select(F.col(word).alias("word")).where("word IS NOT NULL").distinct().withColumn("phonemes", said("word"))


TOKENS = "array<struct<word:string,start:int,pos:string,tag:string,lemma:string>>"


def tagged(df: DataFrame, text: str = "text", out: str = "tokens", nlp: Callable[[str], list] | None = None) -> DataFrame:
    """UDF3: words with their places; ``nlp`` gives (word, start, pos, tag, lemma) of a text, without it tags and lemmas are blank."""
    ship_code(df.sparkSession)
    if nlp is None:
        # words and what stands between them, so that a word's place is the length of all before it
        bits = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_'’]+|[^\p{L}\p{N}_'’]+"), F.lit(0))
        place = F.transform(bits, lambda x, i: F.struct(x.alias("x"), F.aggregate(F.slice(bits, 1, i), F.lit(0), lambda n, y: n + F.length(y)).alias("start")))
        words = F.filter(place, lambda b: b["x"].rlike(r"^[\p{L}\p{N}_'’]"))
        blank = F.lit("")
        return df.withColumn(out, F.transform(words, lambda b: F.struct(b["x"].alias("word"), b["start"].alias("start"), blank.alias("pos"), blank.alias("tag"), blank.alias("lemma"))))
    made = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else [dict(zip(("word", "start", "pos", "tag", "lemma"), x, strict=True)) for x in nlp(t)]), TOKENS)
    return df.withColumn(out, made(text))


# Vowel signs, and sounds that fuse where two words are said as one.
VOWELS = "aeiouɐəɚɪɛʌʊɔɑæɜᵻɒ"
FUSING = {"tʃ": "t+sh -> ch", "dʒ": "d+zh -> j", "tj": "t+y -> ch", "dj": "d+y -> j"}


def difference(parts: Column, whole: Column) -> Column:
    """STR22: how the phonemes of two halves differ from those of the word: n→ng (only n became ŋ, in place), s/z or vowel (the same but for
    signs of that kind, wherever they are), else differs. Each class is an equality of what is left when its signs are made alike."""
    drop = lambda c, signs: F.translate(c, signs, "")
    level = lambda c: F.translate(c, "ŋ", "n")
    raised = F.forall(F.zip_with(F.split(parts, ""), F.split(whole, ""), lambda x, y: (x == y) | ((x == "n") & (y == "ŋ"))), lambda ok: ok)
    same = parts == whole
    return F.when(~same & (level(parts) == level(whole)) & raised, "n→ng").when(~same & (drop(parts, "sz") == drop(whole, "sz")), "s/z").when(~same & (drop(parts, VOWELS) == drop(whole, VOWELS)), "vowel").otherwise("differs")


def judged(splits: DataFrame, phonemes: DataFrame) -> DataFrame:
    """``splits`` (word, left_part, right_part, ...) with ``whole`` and ``split`` phonemes and ``why``: ok, joins (two sounds fuse) or the class of the difference."""
    bare = lambda c: F.regexp_replace(c, "[ˈˌː ]", "")
    table = lambda key, out: phonemes.select(F.col("word").alias(key), F.col("phonemes").alias(out))
    j = splits.join(table("word", "whole"), "word").join(table("left_part", "_a"), "left_part").join(table("right_part", "_b"), "right_part")
    j = j.withColumn("_w", bare("whole")).withColumn("_p", F.concat(bare("_a"), bare("_b")))
    seam: Column = F.concat(F.right(bare("_a"), F.lit(1)), F.left(bare("_b"), F.lit(1)))
    same = j.where(F.col("_w") == F.col("_p")).withColumn("why", F.when(seam.isin(*FUSING), "joins").otherwise("ok"))
    other = j.where(F.col("_w") != F.col("_p")).withColumn("why", difference(F.col("_p"), F.col("_w")))
    return same.unionByName(other).withColumn("split", F.concat_ws(" ", "_a", "_b")).drop("_a", "_b", "_w", "_p")
