"""The segment script: what is said, by which voice, in which style, how fast and with which pause, for each kind of block.

A block's segments are built on its own row. Windows along a chapter add only what a block cannot know: where a run of chat starts, who speaks in it for the
first time, and the number of each segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serialmill.functions import text as T

VOICES = {"narrator": "narrator", "dialogue": "dialogue", "thought": "thought", "system": "interface", "machine": "machine"}
RATES = {"narration": 1.0, "dialogue": 1.0, "thought": 1.0, "heading": 1.0, "system": 0.95, "machine": 0.9, "chat": 1.1}
PAUSES = {"sentence": 250, "paragraph": 600, "dialogue": 350, "scene_break": 1200, "chat": 400, "ellipsis": 300, "cue": 90, "lead": 160}
SEGMENT = "array<struct<kind:string,style:string,voice:string,speaker:string,rate:double,body:string,pause_ms:int>>"


def segment(kind: str, style: Column | str, voice: Column | str, speaker: Column | str, body: Column | str, pause: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    rate = F.lit(RATES[style]) if isinstance(style, str) else F.when(style == "dialogue", RATES["dialogue"]).when(style == "thought", RATES["thought"]).otherwise(RATES["narration"])
    return F.struct(F.lit(kind).alias("kind"), lit(style).alias("style"), lit(voice).alias("voice"), lit(speaker).alias("speaker"), rate.alias("rate"), lit(body).alias("body"), lit(pause).cast("int").alias("pause_ms"))


def stopped(text: Column) -> Column:
    """With a stop at its end, where it has none."""
    return F.when(text.rlike("[.!?…]$"), text).otherwise(F.concat(text, F.lit(".")))


def _each(text: Column, make) -> Column:
    """``make(sentence, is_last)`` for every sentence."""
    return T.bound(T.sentences(text), lambda s: F.transform(s, lambda x, i: make(x, i == F.size(s) - 1)))


def paragraph(body: Column, emphasised: Column) -> Column:
    """Quotes are dialogue, the rest narration, or thought where the block is emphasised; the last sentence of the block has the paragraph's pause, and what trails off a longer one."""
    parts = F.filter(F.transform(F.split(body, '"', -1), lambda x, i: F.struct((i % 2 == 1).alias("quote"), x.alias("x"))), lambda p: F.trim(p["x"]) != "")
    said = F.flatten(F.transform(parts, lambda p: F.transform(T.sentences(p["x"]), lambda x: F.struct(p["quote"].alias("quote"), x.alias("x")))))

    def make(p: Column, last: Column) -> Column:
        style = F.when(emphasised, "thought").when(p["quote"], "dialogue").otherwise("narration")
        voice = F.when(emphasised, VOICES["thought"]).when(p["quote"], VOICES["dialogue"]).otherwise(VOICES["narrator"])
        pause = F.when(last, PAUSES["paragraph"]).otherwise(F.when(style == "dialogue", max(PAUSES["sentence"], PAUSES["dialogue"])).otherwise(PAUSES["sentence"]))
        return segment("speech", style, voice, "", p["x"], pause + F.when(p["x"].rlike(r"(…|\.\.\.)$"), PAUSES["ellipsis"]).otherwise(0))

    return T.bound(said, lambda s: F.transform(s, lambda p, i: make(p, i == F.size(s) - 1)))


def silent(s: Column) -> Column:
    """FLT16: what holds no letter or digit is a pause; a line of dots alone has been given its longer one."""
    return F.when((s["kind"] == "speech") & ~s["body"].rlike(r"[\p{L}\p{N}]"), s.withField("kind", F.lit("pause"))).otherwise(s)


def script(blocks: DataFrame, key: str, pool: int = 7) -> DataFrame:
    """WIN22: (key, seg_no, block_no, kind, style, voice, speaker, rate, body, pause_ms). ``blocks``: key, block_no, kind, body, emphasised, machine, user, location, voice (of a chat handle)."""
    along = Window.partitionBy(key).orderBy("block_no")
    first = F.row_number().over(Window.partitionBy(key, "user").orderBy("block_no")) == 1
    b = blocks.withColumn("_cue", (F.col("kind") == "chat") & (F.coalesce(F.lag("kind").over(along), F.lit("")) != "chat")).withColumn("_new", (F.col("kind") == "chat") & first)
    body, voice, user = F.col("body"), F.concat(F.lit("chat-"), F.col("voice").cast("string")), F.col("user")
    none = F.array().cast(SEGMENT)
    ends = lambda last: F.when(last, PAUSES["paragraph"]).otherwise(PAUSES["sentence"])
    machine = _each(body, lambda x, last: segment("speech", "machine", VOICES["machine"], "", stopped(F.regexp_replace(x, ":$", ".")), ends(last)))
    system = _each(body, lambda x, last: segment("speech", "system", VOICES["system"], "", x, ends(last)))
    heading = F.array(segment("speech", "heading", VOICES["narrator"], "", stopped(body), PAUSES["scene_break"]))
    cue = F.when(F.col("_cue"), F.array(segment("cue", "chat", "", "", "", PAUSES["cue"]))).otherwise(none)
    lead = F.when(F.col("_new"), F.array(segment("speech", "chat", voice, user, T.spoken_handle(user), PAUSES["lead"]))).otherwise(none)
    chat = F.concat(cue, lead, _each(body, lambda x, last: segment("speech", "chat", voice, user, x, F.when(last, PAUSES["chat"]).otherwise(PAUSES["sentence"]))))
    pause = F.array(segment("pause", "narration", "", "", "", PAUSES["scene_break"]))
    made = F.when(F.col("machine"), machine).when(F.col("kind") == "chat", chat).when(F.col("kind") == "scene_break", pause).when(F.col("kind") == "heading", heading).when(F.col("kind") == "system", system).otherwise(paragraph(body, F.col("emphasised")))
    rows = b.select(key, "block_no", F.posexplode(F.transform(made, silent)).alias("_k", "s")).select(key, "block_no", "_k", "s.*")
    seg_no = F.row_number().over(Window.partitionBy(key).orderBy("block_no", "_k")) - 1
    return rows.select(key, seg_no.alias("seg_no"), "block_no", "kind", "style", "voice", "speaker", "rate", "body", "pause_ms")


def markdown(kind: Column, body: Column, user: Column, location: Column, spans: Column) -> Column:
    """SNK2: one block as Markdown: headings, boxes as quotations, chat lines, scene breaks, and paragraphs with their emphasis."""
    who = F.when(location != "", F.concat(F.lit("**"), user, F.lit("** ("), location, F.lit("): "))).otherwise(F.concat(F.lit("**"), user, F.lit("**: ")))
    last = lambda s: F.coalesce(F.try_element_at(s, F.lit(-1))["b"], F.lit(0))
    before = lambda i: F.coalesce(F.get(spans, i - 1)["b"], F.lit(0))
    cut = lambda a, b: F.substring(body, a + 1, b - a)
    parts = F.transform(spans, lambda s, i: F.concat(cut(before(i), s["a"]), F.lit("*"), cut(s["a"], s["b"]), F.lit("*")))
    shown = F.concat(F.array_join(parts, ""), F.substring(body, last(spans) + 1, F.length(body)))
    return F.when(kind == "heading", F.concat(F.lit("## "), body)).when(kind == "system", F.concat(F.lit("> "), body)).when(kind == "chat", F.concat(who, body)).when(kind == "scene_break", "* * *").otherwise(shown)
