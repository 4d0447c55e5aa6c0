"""Queries with SQL twins, and the pipeline against what its stages promise."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from serialmill.llm import pii, simjoin
from tests.llm.helpers import docs, sentence

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_query_matches_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    r = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    want = collections.Counter(tuple(plain(x[cols.index(c)]) for c in df.columns) for x in r.fetchall())
    assert collections.Counter(tuple(map(plain, x)) for x in df.collect()) == want


def test_pipeline_on_a_small_table(spark, tmp_path):
    base = sentence(1, 80)
    rows = [
        (1, base, "aa", "s", 1), (2, base + " end", "aa", "s", 1), (2, base + " end", "aa", "s", 1), (3, None, "aa", "s", 0), (4, "1 2 3 " * 40, "aa", "s", 1), (5, "too short", "aa", "s", 1),
        (6, sentence(2, 80) + " mail me@host.example.com", "bb", None, 1), (None, sentence(3, 70), None, "s", None), (None, sentence(3, 70), None, "s", None), (8, sentence(4, 6000), "bb", "t", 1),
        (1, base, "aa", "r", 5), (1, base, "aa", "r", None),
    ]
    df = docs(spark, rows)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    now, kept = df, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == corpus_pipeline.COLUMNS
        kept[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in now.collect())
    ids = lambda name: [k for null, k in kept[name] if not null]
    assert 3 not in ids("language_id") and 4 not in ids("language_id") and 5 in ids("language_id")
    assert 5 not in ids("quality_rules") and 8 in ids("quality_rules")
    assert ids("ngram_jaccard_join") == [1, 6, 8] and sum(null for null, _ in kept["ngram_jaccard_join"]) == 1
    texts, sources = ({r["doc_id"]: r[c] for r in now.collect()} for c in ("text", "source"))
    assert sources[1] == "r"  # of rows that agree in id and text, the least by language, source and size
    assert texts[6].endswith("mail [EMAIL]") and not any(pii.base_spans(t) for t in texts.values())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r["n_words"] for r in out) == sum(len(t.split()) for t in texts.values())


def test_empty_pipeline(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_row_key_tells_texts_apart(spark):
    df = docs(spark, [(1, "a"), (1, "b"), (1, "a")])
    assert df.select(simjoin.row_key("doc_id", "text")).distinct().count() == 2


def test_language_id_rejects_what_no_language_claims(spark):
    a, b = ["alar", "orim", "enth", "tor", "ish"], ["zuk", "xov", "qiz", "vex", "wug"]
    known = [(i, sentence(i, 40, a if i % 2 else b), "aa" if i % 2 else "bb") for i in range(60)]
    other = [(100, "Быстрая коричневая лиса прыгает через ленивую собаку"), (101, "слово"), (102, "12 34"), (103, None)]
    ids = lambda rows: sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs(spark, rows), "").collect())
    assert ids(known + other) == [*range(60), 101]
    assert ids(other) == [100, 101]  # no language to learn from
