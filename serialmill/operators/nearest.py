"""STR23: the nearest references of words by edit distance, found through an index of the references.

Few references (FEW_REFS, of LONGEST_BITS letters at most) are broadcast as columns of bits. Words are dealt by ranges and sorted, so a task walks them as a tree of prefixes: a letter is one
step of the edit distance to all references at once, and a word begins where it leaves the word before it. So the work goes with the letters that are new, not with the pairs.

More references are entered twice. Under the hashes of their deletion neighbourhoods (a string with up to EDITS letters left out): two strings within EDITS of each
other share one, so an equality join finds all such pairs. And under cells of length and vowel count, with the counts of their letters: no edit changes a
count by more than one, so counts that differ by k are at least k edits apart. Words whose two nearest the first index did not prove look into cells ever
further away, until their second nearest is no further than the cells that were not looked into.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialmill.operators.corpus import dictionary, word_counts
from serialmill.operators.registry import registry
from serialmill.session import shared_folder, ship_code

QUERIES, ORACLES, query = registry()

#: Letters left out in the first index, and the longest string that it holds (a string of n letters has about n^2 / 2 keys); longer ones are found by cells.
EDITS, LONGEST_KEYED = 2, 24
#: Letters whose total, with the length, parts the cells; letters that are counted each, all vowels among them (so a pair never has fewer least edits than its cells). All other characters are one class more.
VOWELS, LETTERS = "aeiou", list("aeioutnhrsdlc")
#: References of one part of a word's candidates, whose best two are taken before the parts meet.
PART = 4096
#: Shares that the words of a cell are dealt to.
SALTS = 16

#: References that are broadcast, and the longest of them: a row of the distance is a word of so many bits.
FEW_REFS, LONGEST_BITS = 20_000, 64
#: Letters of a word whose states are kept for the words after it.
DEPTH = 32

_BEST = "array<struct<dist:int,ref:string>>"


def _without_one(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))


def deletion_keys(s: Column, edits: int = EDITS) -> Column:
    """Hashes of ``s`` with up to ``edits`` characters left out."""
    all_, last = F.array(s), F.array(s)
    for _ in range(edits):
        last = F.array_distinct(F.flatten(F.transform(last, lambda x: F.when(F.length(x) > 0, _without_one(x)).otherwise(F.array().cast("array<string>")))))
        all_ = F.concat(all_, last)
    return F.array_distinct(F.transform(all_, lambda x: F.xxhash64(x)))


def _counted(df: DataFrame, name: str, mark: str) -> DataFrame:
    """Length, vowels and letter counts of column ``name`` (the last: all letters not counted), as columns that begin with ``mark``."""
    size = F.length(name)
    of = lambda letters: size - F.length(F.translate(name, letters, ""))
    counts = [of(c) for c in LETTERS] + [size - of("".join(LETTERS))]
    return df.select("*", size.alias(f"{mark}len"), of(VOWELS).alias(f"{mark}vowels"), *[c.alias(f"{mark}{k}") for k, c in enumerate(counts)])


def _least_edits(diffs: list[Column], longer: Column) -> Column:
    """Edits that differences of counts call for: the letters that must go or those that must come, whichever are more. Each difference is named once, so the code stays small."""
    return ((sum(map(F.abs, diffs), F.lit(0)) + F.abs(longer)) / 2).cast("int")


def _best_two(pairs: DataFrame, n_refs: int) -> DataFrame:
    """(word, dist, ref) -> (word, b): the two nearest of each word, first by distance, then by reference."""
    two = lambda c: F.slice(F.array_sort(c), 1, 2)
    parts = -(-n_refs // PART)
    one = F.collect_set(F.struct("dist", "ref"))
    if parts <= 1:
        return pairs.groupBy("word").agg(two(one).alias("b"))
    dealt = pairs.groupBy("word", F.pmod(F.xxhash64("ref"), F.lit(parts)).alias("part")).agg(two(one).alias("b"))
    return dealt.groupBy("word").agg(two(F.flatten(F.collect_list("b"))).alias("b"))


def cell_pairs(rest: DataFrame, refs: DataFrame, prev: int, upto: int) -> DataFrame:
    """(word, b) and (ref) -> (word, ref, most) whose least edits are over ``prev`` (any, for words without a second nearest, whose far pairs were not kept), at most ``upto`` and
    no more than the word's second nearest so far; no distance over ``most`` can matter for the word in this round."""
    r, second = _counted(refs, "ref", "r"), F.get("b", F.lit(1))["dist"]
    w = _counted(rest.select("word", F.coalesce(second, F.lit(2 * upto)).alias("most"), F.when(second.isNull(), 0).otherwise(prev + 1).alias("first")), "word", "w")
    known = r.select("rlen", "rvowels").distinct()
    span = known.agg(F.min("rlen").alias("lo"), F.max("rlen").alias("hi")).first()
    lo, hi = F.greatest(F.col("wlen") - upto, F.lit(span["lo"])), F.least(F.col("wlen") + upto, F.lit(span["hi"]))
    longer, vowels = F.col("wlen") - F.col("rlen"), F.col("wvowels") - F.col("rvowels")
    cells = w.select("wlen", "wvowels").distinct().where(lo <= hi).select("*", F.explode(F.sequence(lo, hi)).alias("rlen"))
    near = cells.join(known, "rlen").where(_least_edits([vowels, longer - vowels], longer) <= upto).join(r, ["rlen", "rvowels"])
    parts, salt = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.sequence(F.lit(0), F.lit(SALTS - 1))
    keys = ["wlen", "wvowels", "salt"]  # a cell that many words share is dealt to SALTS tasks; numbers of tasks are given, as few bytes are much work
    w = w.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")).repartition(parts, *keys)
    pairs = w.join(near.withColumn("salt", F.explode(salt)).repartition(parts, *keys).hint("shuffle_hash"), keys)
    least = _least_edits([F.col(f"w{k}") - F.col(f"r{k}") for k in range(len(LETTERS) + 1)], longer)
    first, last = F.col("first"), F.least(F.lit(upto), F.col("most"))
    return pairs.where(F.abs(2 * least - first - last) <= last - first).select("word", "ref", "most")  # least is between the two, named once


def walk(words, refs: list[str]):
    """(dist, ref) of the two nearest of ``refs`` (sorted) for each of ``words``, fastest where these are sorted: the rows of the edit distance as differences in bits (Myers, Hyyrö)."""
    one, n = np.uint64(1), len(refs)
    sizes = np.array([len(r) for r in refs], np.uint64)
    at, place, none = {}, np.arange(n, dtype=np.uint64), np.zeros(n, np.uint64)
    for k, r in enumerate(refs):
        for i, c in enumerate(r):
            at.setdefault(c, np.zeros(n, np.uint64))[k] |= one << np.uint64(i)
    last = np.maximum(sizes, one) - one
    empty = bool(refs) and refs[0] == ""
    states, before = [(np.full(n, ~np.uint64(0)), none, sizes)], ""  # higher, lower, distance after each letter
    for w in words:
        same = 0
        while same < min(len(w), len(before), len(states) - 1) and w[same] == before[same]:
            same += 1
        del states[same + 1 :]
        up, down, dist = states[same]
        for depth, c in enumerate(w[same:], same + 1):
            x = at.get(c, none) | down
            diagonal = (((x & up) + up) ^ up) | x
            less, more = up & diagonal, down | ~(up | diagonal)
            dist = dist + ((more >> last) & one) - ((less >> last) & one)
            if empty:
                dist[0] = depth
            more = (more << one) | one
            up, down = (less << one) | ~(more | diagonal), more & diagonal
            if depth <= DEPTH and depth == len(states):
                states.append((up, down, dist))
        before, order = w, dist * np.uint64(n) + place
        best = [int(order.argmin())]
        if n > 1:
            order[best[0]] = ~np.uint64(0)
            best.append(int(order.argmin()))
        yield [(int(dist[k]), refs[k]) for k in best]


def by_prefix(words: DataFrame, refs: list[str], parts: int) -> DataFrame:
    """(word, b): the two nearest of a few references, as ``_best_two``."""
    spark = words.sparkSession
    ship_code(spark)
    known = spark.sparkContext.broadcast(sorted(refs))
    kind = pa.list_(pa.struct([("dist", pa.int32()), ("ref", pa.string())]))

    def found(batches):
        ws = []

        def each():
            for batch in batches:
                ws.append(batch.column(0))
                yield from batch.column(0).to_pylist()

        made, out = walk(each(), known.value), []
        for b in made:
            out.append([{"dist": d, "ref": r} for d, r in b])
            if len(out) == len(ws[0]):
                yield pa.RecordBatch.from_arrays([ws.pop(0), pa.array(out, kind)], ["word", "b"])
                out = []

    dealt = words.select("word").repartitionByRange(parts, "word").sortWithinPartitions("word")
    return dealt.mapInArrow(found, f"word string, b {_BEST}")


def nearest_of(words: DataFrame, refs: DataFrame) -> DataFrame:
    """(word) and (ref) -> the nearest reference of each word by edit distance, the first of equals; ``margin``: how much further the next one is (null with one
    reference); ``fit``: 1 less the distance by the longer length. Exact for words of any length. Null words and references and repeated ones are left out; without
    references there are no rows."""
    spark, folder = words.sparkSession, shared_folder(words.sparkSession)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stored(df, name):  # dealt anew: what few bytes hold may be much work
        df.repartition(parts, df.columns[0]).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    refs = stored(refs.where("ref IS NOT NULL").select("ref").distinct(), "refs")
    words = stored(words.where("word IS NOT NULL").select("word").distinct(), "words")
    n_refs, longest = refs.agg(F.count("*"), F.max(F.length("ref"))).first()
    if not n_refs:
        return spark.createDataFrame([], "word string, nearest string, dist bigint, margin bigint, fit double")
    if n_refs <= FEW_REFS and longest <= LONGEST_BITS:
        return _margins(by_prefix(words, [r["ref"] for r in refs.toLocalIterator()], 4 * parts))
    longest = max(longest, words.agg(F.coalesce(F.max(F.length("word")), F.lit(0))).first()[0])
    keyed = lambda df, c: df.where(F.length(c) <= LONGEST_KEYED).select(c, F.explode(deletion_keys(F.col(c))).alias("key"))
    met = keyed(words, "word").join(keyed(refs, "ref"), "key").select("word", "ref", F.levenshtein("word", "ref", EDITS).alias("dist")).where("dist >= 0")
    looked = stored(words.join(_best_two(met, n_refs), "word", "left").withColumn("b", F.coalesce("b", F.array().cast(_BEST))), "keyed")
    proved = [looked.where(F.size("b") == 2)]
    rest, prev, upto = looked.where(F.size("b") < 2), -1, EDITS
    second = F.get("b", F.lit(1))["dist"]
    while not rest.isEmpty():
        # distances up to twice the round's are kept: they bound what the next round looks at
        found = cell_pairs(rest, refs, prev, upto).select("word", "ref", F.expr("levenshtein(word, ref, most)").alias("dist")).where("dist >= 0")
        before = rest.select("word", F.inline("b")).select("word", "ref", "dist")
        looked = stored(rest.select("word").join(_best_two(found.unionByName(before), n_refs), "word", "left").withColumn("b", F.coalesce("b", F.array().cast(_BEST))), f"upto_{upto}")
        done = F.lit(True) if upto >= longest else F.coalesce(second <= upto, F.lit(False))
        proved.append(looked.where(done))
        rest, prev, upto = looked.where(~done), upto, 2 * upto
    out = proved[0]
    for p in proved[1:]:
        out = out.unionByName(p)
    return _margins(out)


def _margins(out: DataFrame) -> DataFrame:
    one, first = F.get("b", F.lit(1)), F.get("b", F.lit(0))
    fit = F.round(1 - first["dist"] / F.greatest(F.length("word"), F.length(first["ref"]), F.lit(1)), 6)
    return out.select("word", first["ref"].alias("nearest"), first["dist"].cast("bigint").alias("dist"), (one["dist"] - first["dist"]).cast("bigint").alias("margin"), fit.alias("fit"))


@query("str23_nearest_word", """WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS ref FROM benchmark),
m AS (SELECT word, min({'dist': levenshtein(word, ref), 'ref': ref}, 2) AS b FROM v, b GROUP BY word)
SELECT word, b[1].ref AS nearest, b[1].dist AS dist, b[2].dist - b[1].dist AS margin, round(1 - b[1].dist / greatest(length(word), length(b[1].ref))::DOUBLE, 6) AS fit FROM m""")
def nearest_word(spark, d):
    """Every word of the corpus against the benchmark's words."""
    return nearest_of(word_counts(spark, d).select("word"), dictionary(spark, d).withColumnRenamed("word", "ref"))
