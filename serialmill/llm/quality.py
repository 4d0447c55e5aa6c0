"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps one bit for each failed rule
beside the measurements. A policy is a named, versioned set of rule bits: applying one, or asking
what each of its rules costs (ablation), is bitwise work on the stored ledger and never reads a
text again. Everything is built-in column expressions; the pass over the texts has no shuffle.

Defined results: a null text counts as the empty text (no words, so the rule ``too_few_words``
fails); an empty table gives an empty ledger; repeated rows are kept as they are; an input column
whose name the ledger also uses is replaced by the ledger's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialmill.llm.common import words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims")
_TMP = ("_q_words", "_q_lines", "_q_windows", "_q_dups")


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # a SQL condition over the measurements


#: Thresholds are integers on both sides, so no rule depends on rounding.
RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbol_heavy", "100 * n_symbols > 50 * n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    Rule(4, "shouting", "100 * n_exclaims > 50 * n_words"),
    Rule(5, "odd_word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
)
BASE_BITS = 0b11

#: Policies by version: the bits that reject a document.
POLICIES = {"v1": 0b111111, "base": BASE_BITS, "no_shouting_rule": 0b101111}


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input columns, the measurements and ``failure_bits``."""
    out_names = {*MEASURES, "failure_bits"}
    keep = [c for c in docs.columns if c not in out_names or c == text]
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        words(F.col(text)).alias(_TMP[0]),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")).alias(_TMP[1]),
        (F.size(F.split(body, r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size(F.split(body, "!", -1)) - 1).cast("long").alias("n_exclaims"),
    )
    df = df.select("*", F.size(_TMP[0]).cast("long").alias("n_words"), _windows(F.col(_TMP[0])).alias(_TMP[2]))
    df = df.select("*", _repeated_positions(F.col(_TMP[2])).alias(_TMP[3]))
    measured = F.struct(
        "n_words",
        F.length(F.array_join(_TMP[0], "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size(_TMP[1]) - F.size(F.array_distinct(_TMP[1]))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.flatten(F.transform(_TMP[3], lambda i: F.array(i, i + 1, i + 2))))).cast("long").alias("n_repeat_words"),
        F.size(_TMP[1]).cast("long").alias("n_lines"),
        "n_exclaims",
    )
    # a generator, so that a filter on the ledger is not pushed below the measurements and does not repeat them
    df = df.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(measured)))
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return df.withColumn("failure_bits", bits)


def _windows(w: Column) -> Column:
    """A 64-bit fingerprint for each 3-word window."""
    at = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), at)).otherwise(F.array().cast("array<bigint>"))


def _repeated_positions(windows: Column) -> Column:
    """Positions of windows found twice or more. Only texts with a repeat are sorted."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<int>")
    picked = F.aggregate(  # one pass over the sorted pairs would need a growing array; neighbours are compared instead
        F.array(ordered), none, lambda _, s: F.transform(
            F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"]))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), picked).otherwise(none)


def apply_policy(led: DataFrame, policy: str = "v1", out: str = "kept") -> DataFrame:
    return led.withColumn(out, F.col("failure_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablation(led: DataFrame, policy: str = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents failing it, failing nothing else, and kept if it were dropped."""
    mask = POLICIES[policy]
    bits = F.col("failure_bits").bitwiseAND(F.lit(mask))
    used = [r for r in rules if mask >> r.bit & 1]
    sums = [F.count(F.lit(1)).alias("n_docs"), F.count_if(bits == 0).alias("n_kept")]
    for r in used:
        sums += [F.count_if(bits.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"f{r.bit}"), F.count_if(bits == 1 << r.bit).alias(f"o{r.bit}")]
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failing"), F.col(f"o{r.bit}").alias("n_only_this"), (F.col("n_kept") + F.col(f"o{r.bit}")).alias("n_kept_without")) for r in used])
    return led.agg(*sums).select("n_docs", "n_kept", F.inline(rows))


ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS body FROM documents
), w AS (
  SELECT row_number() OVER () AS rid, doc_id, body,
    list_filter(string_split_regex(body, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls
  FROM base
), pos AS (
  SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w WHERE len(ws) >= 3
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i+1], ws[i+2]) AS c FROM pos
), cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM win WHERE c > 1) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_lines,
    length(regexp_replace(body, '[^!]', '', 'g'))::BIGINT AS n_exclaims
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, ((n_words < 50)::BIGINT + (100*n_repeat_words > 50*n_words)::BIGINT*2 + (100*n_symbols > 50*n_words)::BIGINT*4
    + (n_lines >= 4 AND 100*n_dup_lines > 60*n_lines)::BIGINT*8 + (100*n_exclaims > 50*n_words)::BIGINT*16
    + (word_chars < 2*n_words OR word_chars > 25*n_words)::BIGINT*32) AS failure_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failure_bits & 3) <> 0 AS base_failed, failure_bits = 0 AS kept, failure_bits
FROM b
"""
