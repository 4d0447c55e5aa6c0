from serialmill.llm import quality
from tests.llm.helpers import docs, sentence


def brute(text):
    ws = [w for w in __import__("re").split(r"[ \t\n\x0b\x0c\r]+", text or "") if w]
    tri = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    rep = {p for i, t in enumerate(tri) if tri.count(t) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep)


CASES = [None, "", " \n\t ", "one", "a b c a b c", "x y z\nx y z\n\nq", "a\x0bb\x0cc\rd", sentence(1, 60), "so so so so so " * 30, "#*$%&|<> é ü", "A!! B!! C!!\n" * 20]


def test_measures_match_brute_force(spark):
    df = docs(spark, [(i, t) for i, t in enumerate(CASES)])
    got = {r["doc_id"]: r for r in quality.apply_policy(quality.ledger(df)).collect()}
    for i, t in enumerate(CASES):
        r = got[i]
        n, chars, sym, dup, rep = brute(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, sym, dup, rep), t
        base = n < 50 or 100 * rep > 50 * n
        assert (r["failure_bits"] & quality.BASE_BITS != 0) == base
        assert not (base and r["kept"])
    assert got[7]["kept"]


def test_repeats_clashes_and_empty(spark):
    df = docs(spark, [(1, sentence(2, 60))] * 2).withColumnRenamed("source", "n_words")
    out = quality.ledger(df)
    assert out.count() == 2 and out.columns.count("n_words") == 1 and out.first()["n_words"] == 60
    assert quality.ledger(docs(spark, [])).count() == 0


def test_ablation(spark):
    df = docs(spark, [(1, sentence(3, 60)), (2, "short"), (3, " ".join(f"{w}!" for w in sentence(4, 60).split()))])
    rows = {r["rule"]: r for r in quality.ablation(quality.ledger(df)).collect()}
    assert rows["shouting"]["n_kept_without"] == 2 and rows["shouting"]["n_only_this"] == 1 and rows["too_few_words"]["n_failing"] == 1
