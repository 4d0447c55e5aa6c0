"""Machine-voice runs and title echoes on literal blocks."""

from pyspark.sql import functions as F

from serialmill.functions import runs

# The cases of this file fix the behaviour of the rules.
RUNS = [
    (["She answered. //5B.//"], [("She answered.", False), ("5B.", True)]),
    (["//Status:", ("system", "HP 5"), "Report//.", "Plain"], [("Status:", True), ("HP 5", True), ("Report", True), ("Plain", False)]),
    (["//Never closed", "plain text", "more"], [("Never closed", True), ("plain text", False), ("more", False)]),
    (["//Open", ("emphasised", "in italics"), "x"], [("Open", True), ("in italics", True), ("x", False)]),
    (["//Open", ("heading", "Head"), ("system", "tail")], [("Open", True), ("Head", False), ("tail", False)]),
    (["see http://a.b/c", "a //b// c"], [("see http://a.b/c", False), ("a", False), ("b", True), ("c", False)]),
    ([""], [("", False)]),
    (["// // foo", ("system", "bar")], [("foo", False), ("bar", False)]),  # opens, then turns
    (["a // b // c // d //."], [("a", False), ("b", True), ("c", False), ("d", True)]),
]


def test_machine_runs(spark):
    rows = []
    for k, (blocks, _) in enumerate(RUNS):
        for n, b in enumerate(blocks):
            kind, text = b if isinstance(b, tuple) else ("paragraph", b)
            rows.append((k, n, "paragraph" if kind == "emphasised" else kind, text, kind == "emphasised"))
    got = runs.machine_runs(spark.createDataFrame(rows, "doc_id int, block_no int, kind string, body string, emphasised boolean")).collect()
    for k, (_, want) in enumerate(RUNS):
        mine = sorted((r["block_no"], r["piece"], r["body"].strip(), r["machine"]) for r in got if r["doc_id"] == k)
        assert [m[2:] for m in mine] == want


def test_title_echo(spark):
    forms = spark.createDataFrame([("Chapter 17 - Plans Manifest",)], "t string").select(runs.title_forms(F.col("t"))).first()[0]
    assert {"17", "chapter 17", "seventeen", "plans manifest", "chapter 17 plans manifest", "chapter seventeen plans manifest"} <= set(forms)
    text = [("heading", "Chapter 17"), ("paragraph", "Plans Manfiest"), ("paragraph", "It rained."), ("paragraph", "17")]
    cases = [
        (text, "Chapter 17 - Plans Manifest", text[2:]), (text, "Other", text), ([], "x", []), (text, "", text), ([("paragraph", "x" * 121)], "x" * 121, [("paragraph", "x" * 121)]),
        ([("paragraph", "Chapter Seventeen"), ("paragraph", "The Gate"), ("paragraph", "On.")], "Chapter 17: The Gate", [("paragraph", "On.")]), ([("paragraph", "17")] * 6, "17", [("paragraph", "17")] * 2),
        ([("system", "17")], "17", [("system", "17")]),
    ]
    df = spark.createDataFrame([(b, t) for b, t, _ in cases], "blocks array<struct<kind:string,body:string>>, title string")
    got = [[tuple(b) for b in r[0]] for r in df.select(runs.without_title(F.col("blocks"), F.col("title"))).collect()]
    assert got == [want for _, _, want in cases]
