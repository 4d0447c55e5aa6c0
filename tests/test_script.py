"""The segment script and Markdown of blocks of every kind, on literal rows."""

from pyspark.sql import functions as F

from serialmill.functions import script, spans

BLOCKS = "ch int, block_no int, kind string, body string, emphasised boolean, machine boolean, user string, location string, voice int"


def blocks(spark, *rows):
    full = [(1, n, k, b, "e" in f, "m" in f, u, p, v) for n, (k, b, f, u, p, v) in enumerate((*r, *("", "", "", None)[len(r) - 2 :])[:6] for r in rows)]
    return spark.createDataFrame(full, BLOCKS)


def test_script(spark):
    b = blocks(
        spark, ("heading", "Dead Air"), ("paragraph", 'She ran. "Stop! Now..." He fell'), ("paragraph", "Why me?", "e"), ("system", "Level: 7. Rank: B"), ("paragraph", "Status: go:", "m"),
        ("chat", "hi. there", "", "Bob7", "Earth", 3), ("chat", "yo", "", "Ann", "", 2), ("scene_break", ""), ("chat", "again", "", "Bob7", "", 3), ("paragraph", "…"),
    )
    got = [(r["kind"], r["style"], r["voice"], r["speaker"], r["rate"], r["body"], r["pause_ms"]) for r in sorted(script.script(b, "ch").collect(), key=lambda r: r["seg_no"])]
    assert got == [
        ("speech", "heading", "narrator", "", 1.0, "Dead Air.", 1200),
        ("speech", "narration", "narrator", "", 1.0, "She ran.", 250), ("speech", "dialogue", "dialogue", "", 1.0, "Stop!", 350), ("speech", "dialogue", "dialogue", "", 1.0, "Now...", 650),
        ("speech", "narration", "narrator", "", 1.0, "He fell", 600), ("speech", "thought", "thought", "", 1.0, "Why me?", 600),
        ("speech", "system", "interface", "", 0.95, "Level: 7.", 250), ("speech", "system", "interface", "", 0.95, "Rank: B", 600), ("speech", "machine", "machine", "", 0.9, "Status: go.", 600),
        ("cue", "chat", "", "", 1.1, "", 90), ("speech", "chat", "chat-3", "Bob7", 1.1, "Bob 7", 160), ("speech", "chat", "chat-3", "Bob7", 1.1, "hi. there", 400),
        ("speech", "chat", "chat-2", "Ann", 1.1, "Ann", 160), ("speech", "chat", "chat-2", "Ann", 1.1, "yo", 400), ("pause", "narration", "", "", 1.0, "", 1200),
        ("cue", "chat", "", "", 1.1, "", 90), ("speech", "chat", "chat-3", "Bob7", 1.1, "again", 400), ("pause", "narration", "narrator", "", 1.0, "…", 900),
    ]


def test_markdown(spark):
    rows = [("heading", "One", "", "", []), ("system", "HP: 5", "", "", []), ("chat", "hi", "Bob", "Earth", []), ("chat", "hi", "Bob", "", []), ("scene_break", "", "", "", []), ("paragraph", "so it goes on", "", "", [(0, 2), (6, 10)])]
    df = spark.createDataFrame(rows, f"kind string, body string, user string, location string, s {spans.SPANS}")
    got = [r[0] for r in df.select(script.markdown(F.col("kind"), F.col("body"), F.col("user"), F.col("location"), F.col("s"))).collect()]
    assert got == ["## One", "> HP: 5", "**Bob** (Earth): hi", "**Bob**: hi", "* * *", "*so* it *goes* on"]
