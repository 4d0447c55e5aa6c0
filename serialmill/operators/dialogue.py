"""Conversations as dialogue and chat: speakers, voices, runs, chat lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from serialmill.functions import script, spans, speakers
from serialmill.functions import text as T
from serialmill.operators.corpus import text_blocks
from serialmill.operators.registry import registry
from serialmill.sources.bindings import table, turns

QUERIES, ORACLES, query = registry()

_T = "turns AS (SELECT conv_id, turn, role AS speaker, text FROM conversations)"


@query("agg3_speaker_counts", f"WITH {_T} SELECT speaker, count(*) AS n_lines, count(DISTINCT conv_id) AS n_chapters FROM turns GROUP BY speaker")
def speaker_counts(spark, d):
    return turns(spark, d).groupBy("speaker").agg(F.count("*").alias("n_lines"), F.count_distinct("conv_id").alias("n_chapters"))


@query("srt4_top_speakers", f"""WITH {_T}, c AS (SELECT conv_id % 40 AS name, count(*) AS n FROM turns GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS k FROM c)
SELECT CASE WHEN k <= 15 THEN name END AS name, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def top_speakers(spark, d, most: int = 15):
    """The top speakers, the rest as one row (a top-k report over speakers, not lines)."""
    c = turns(spark, d).groupBy((F.col("conv_id") % 40).alias("name")).agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.orderBy(F.col("n").desc(), "name"))
    return c.withColumn("k", k).groupBy(F.when(F.col("k") <= most, F.col("name")).alias("name")).agg(F.sum("n").alias("n"))


@query("set3_new_speakers", f"WITH {_T} SELECT DISTINCT speaker || '-' || conv_id % 50 AS speaker FROM turns WHERE turn > 1 EXCEPT SELECT speaker || '-' || conv_id % 50 FROM turns WHERE turn <= 1 AND conv_id % 2 = 0")
def new_speakers(spark, d):
    name = F.concat_ws("-", "speaker", (F.col("conv_id") % 50).cast("string")).alias("speaker")
    t = turns(spark, d)
    return t.where("turn > 1").select(name).distinct().join(t.where("turn <= 1 AND conv_id % 2 = 0").select(name).distinct(), "speaker", "left_anti")


@query("win10_sticky_speaker", f"""WITH {_T}, s AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN NULL ELSE speaker END AS said FROM turns)
SELECT conv_id, turn, last_value(said IGNORE NULLS) OVER w AS sticky, count(said) OVER w AS n_named FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def sticky_speaker(spark, d):
    """The last named speaker holds until another is named."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    said = F.when(F.col("turn") % 3 != 1, F.col("speaker"))
    return turns(spark, d).select("conv_id", "turn", F.last(said, ignorenulls=True).over(w).alias("sticky"), F.count(said).over(w).alias("n_named"))


@query("win7_chat_runs", f"""WITH {_T}
SELECT conv_id, turn, speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY conv_id ORDER BY turn) AS run_start, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY turn) = 1 AS first_seen FROM turns""")
def chat_runs(spark, d):
    """Where a run of one speaker starts, and each handle's first announcement."""
    prev = F.lag("speaker").over(Window.partitionBy("conv_id").orderBy("turn"))
    first = F.row_number().over(Window.partitionBy("conv_id", "speaker").orderBy("turn")) == 1
    return turns(spark, d).select("conv_id", "turn", (~F.col("speaker").eqNullSafe(prev)).alias("run_start"), first.alias("first_seen"))


# Labels that are no handles.
SYSTEM_WORDS = """target objective quest mission system warning alert error notice status update analysis scan scanning
affirmative negative ping alarm note task designation species race class rank level skill title""".split()

# The two shapes of a chat line, the letters of a handle, what a stat value may hold and what is set aside in it.
PLACED = r"(?s)^\s*(.{2,40}?)\s*\(\s*([^)]{1,30}?)\s*\)\s*:\s*(.+)$"
BARE = r"(?s)^\s*([^:()\[\]]{2,40}?)\s*:\s*(.+)$"
HANDLE = "^[A-Za-z0-9][A-Za-z0-9_. ]*$"
STAT_VALUE = r"^[\d\s.,/|%+\-:=<>]*$"
SET_ASIDE = r"\([^)]*\)|[^\x00-\x7f]"


def parse_chat(line):
    """struct<user, location, message> of ``[Handle (Place): message]`` or ``[Handle: message]``, or null."""
    inner = F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), r"^\[+", ""), r"\]+$", ""))
    has_place = inner.rlike(PLACED)
    user = F.trim(F.rtrim(F.when(has_place, F.regexp_extract(inner, PLACED, 1)).otherwise(F.regexp_extract(inner, BARE, 1)), F.lit(":")))
    place = F.when(has_place, F.trim(F.regexp_extract(inner, PLACED, 2))).otherwise("")
    message = F.trim(F.when(has_place, F.regexp_extract(inner, PLACED, 3)).otherwise(F.regexp_extract(inner, BARE, 2)))
    core = F.regexp_replace(message, SET_ASIDE, " ")
    stat = core.rlike("[0-9]") & core.rlike(STAT_VALUE)
    letters = user.rlike(r"^\p{L}+$")
    bad_bare = F.lower(user).isin(SYSTEM_WORDS) | user.contains(" ") | (letters & (F.upper(user) == user) & (F.length(user) >= 3)) | (letters & stat)
    ok = F.startswith(line, F.lit("[")) & F.rtrim(line).endswith("]") & (has_place | inner.rlike(BARE)) & (user != "") & user.rlike(HANDLE) & ((place != "") | ~bad_bare)
    return F.when(ok, F.struct(user.alias("user"), place.alias("location"), message.alias("message")))


@query("flt10_chat_lines", f"""WITH {_T}, l AS (SELECT conv_id, turn, '[' || speaker || conv_id || CASE WHEN turn % 2 = 0 THEN ' (Earth)' ELSE '' END || ': ' || turn || ' words]' AS line FROM turns WHERE conv_id % 4 <> 0
  UNION ALL SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '[Target: ' || conv_id || ']' WHEN 1 THEN '[HP: 5/' || conv_id || ']' ELSE 'plain ' || conv_id END FROM turns WHERE conv_id % 4 = 0)
SELECT conv_id, turn, nullif(regexp_extract(line, '^\\[([a-z]+[0-9]+)', 1), '') AS handle, CASE WHEN regexp_matches(line, '^\\[[a-z]+[0-9]') THEN CASE WHEN contains(line, '(Earth)') THEN 'Earth' ELSE '' END END AS location FROM l""")
def chat_lines(spark, d):
    t = turns(spark, d)
    n = F.col("conv_id").cast("string")
    chat = F.concat(F.lit("["), "speaker", n, F.when(F.col("turn") % 2 == 0, " (Earth)").otherwise(""), F.lit(": "), F.col("turn").cast("string"), F.lit(" words]"))
    other = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("[Target: "), n, F.lit("]"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("[HP: 5/"), n, F.lit("]"))).otherwise(F.concat(F.lit("plain "), n))
    line = F.when(F.col("conv_id") % 4 != 0, chat).otherwise(other)
    p = t.select("conv_id", "turn", line.alias("line")).select("conv_id", "turn", parse_chat(F.col("line")).alias("c"))
    return p.select("conv_id", "turn", F.col("c.user").alias("handle"), F.col("c.location").alias("location"))


#: Lines as they stand in a text: plain ones, readouts (a label that is no handle, several words without a colon), and lines that may be chat.
_LINE_SQL = """CASE (conv_id * 7 + turn * 3) % 8 WHEN 0 THEN 'They went on.' WHEN 1 THEN '[Quest: find ' || turn || ']' WHEN 2 THEN '[A door opens]' WHEN 3 THEN '[System: go]'
  WHEN 4 THEN '[' || role || conv_id || ': well said]' WHEN 5 THEN '[' || role || conv_id || ' (Earth): hi]' ELSE '[Host: ' || role || ']' END"""


@query("win8_bracket_runs", f"""WITH l AS (SELECT conv_id, turn, {_LINE_SQL} AS line FROM conversations),
k AS (SELECT *, starts_with(line, '[') AS bracket, CASE WHEN NOT starts_with(line, '[') THEN 'plain' WHEN starts_with(line, '[Quest') OR starts_with(line, '[System') OR NOT contains(line, ':') THEN 'system' ELSE 'chat' END AS kind, contains(line, '(') AS placed FROM l),
g AS (SELECT *, count(*) FILTER (NOT bracket) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM k)
SELECT conv_id, turn, CASE WHEN kind = 'chat' AND NOT placed AND count(*) FILTER (kind = 'system') OVER r >= 2 AND count(*) FILTER (kind = 'system') OVER r >= count(*) FILTER (kind = 'chat' AND NOT placed) OVER r THEN 'system' ELSE kind END AS typed
FROM g WINDOW r AS (PARTITION BY conv_id, run)""")
def bracket_runs(spark, d):
    """Bracketed lines are chat if they parse as it, else system. In a run of them two system lines or more outvote as many that may be chat; a line with a place is always chat."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_LINE_SQL).alias("line"))
    return bracket_kinds(lines, "conv_id", "turn").select("conv_id", "turn", "typed")


def bracket_kinds(lines, key: str, order: str):
    """WIN8: ``lines`` (key, order, line) with ``typed``: plain, system or chat."""
    k = lines.withColumn("_chat", parse_chat(F.col("line"))).withColumn("_bracket", F.coalesce(F.trim("line").rlike(r"(?s)^\[.*\]$"), F.lit(False)))
    k = k.withColumn("_kind", F.when(~F.col("_bracket"), "plain").when(F.col("_chat").isNull(), "system").otherwise("chat"))
    k = k.withColumn("_run", F.count_if(~F.col("_bracket")).over(Window.partitionBy(key).orderBy(order)))
    run = Window.partitionBy(key, "_run")
    open_ = (F.col("_kind") == "chat") & (F.col("_chat.location") == "")
    n_system, n_open = F.count_if(F.col("_kind") == "system").over(run), F.count_if(F.coalesce(open_, F.lit(False))).over(run)
    typed = F.when(open_ & (n_system >= 2) & (n_system >= n_open), "system").otherwise(F.col("_kind"))
    return k.withColumn("typed", typed).drop("_chat", "_bracket", "_kind", "_run")


POOL = 7
_HEX = "0123456789abcdef"


@query("win19_voice_pick", f"""WITH h AS (SELECT DISTINCT conv_id, role || conv_id AS handle FROM conversations)
SELECT conv_id, handle, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha1(handle), ''), lambda c: (strpos('{_HEX}', c) - 1)::BIGINT)), lambda a, x: (a * 16 + x) % {POOL})::INT AS voice FROM h""")
def voice_pick(spark, d, pool: int = POOL):
    """A handle's place in a pool: its sha1 modulo the pool's size."""
    h = turns(spark, d).select("conv_id", F.concat("speaker", F.col("conv_id").cast("string")).alias("handle")).distinct()
    digits = F.filter(F.split(F.sha1("handle"), ""), lambda c: c != "")
    value = lambda c: F.call_function("instr", F.lit(_HEX), c) - 1
    mod = F.aggregate(digits, F.lit(0), lambda a, c: ((a * 16 + value(c)) % pool).cast("int"))
    return h.select("conv_id", "handle", mod.alias("voice"))


def chat_voices(handles, key: str, pool: int):
    """WIN19: (key, handle, place, pin) -> (key, handle, voice). In the order of their places: a pinned handle has its pin; another one the voice of its hash, or, if that is taken
    while a voice is free, the first free one. Once as many handles without a pin came as there are voices, none is free; so only those before are folded, with the
    taken voices as bits, and all later ones have their hash."""
    digits = F.filter(F.split(F.sha1("handle"), ""), lambda c: c != "")
    value = lambda c: F.call_function("instr", F.lit(_HEX), c) - 1
    hashed = F.aggregate(digits, F.lit(0), lambda a, c: ((a * 16 + value(c)) % pool).cast("int"))
    along = Window.partitionBy(key).orderBy("place", "handle").rowsBetween(Window.unboundedPreceding, 0)
    h = handles.withColumn("_hash", hashed).withColumn("_free", F.count_if(F.col("pin").isNull()).over(along))
    late = h.where(F.col("_free") > pool).select(key, "handle", F.coalesce("pin", "_hash").alias("voice"))
    g = h.where(F.col("_free") <= pool).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "handle", "pin", "_hash"))).alias("h"))
    bit = lambda v: F.call_function("shiftleft", F.lit(1).cast("bigint"), v)
    taken = lambda used, v: F.call_function("getbit", used, v) == 1
    first = lambda used: F.get(F.filter(F.sequence(F.lit(0), F.lit(pool - 1)), lambda v: ~taken(used, v)), F.lit(0))

    def step(a, x):
        voice = F.coalesce(x["pin"], F.when(taken(a["used"], x["_hash"]) & (F.bit_count(a["used"]) < pool), first(a["used"])).otherwise(x["_hash"]))
        return F.struct(a["used"].bitwiseOR(bit(voice)).alias("used"), F.concat(a["voices"], F.array(voice)).alias("voices"))

    voices = F.aggregate("h", F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("voices")), step)["voices"]
    early = g.select(key, F.inline(F.zip_with("h", voices, lambda x, v: F.struct(x["handle"].alias("handle"), v.alias("voice")))))
    return early.unionByName(late)


@query("win19_first_voices", f"""WITH RECURSIVE t AS (SELECT conv_id % 20 AS chapter, role || conv_id % 60 AS handle, conv_id * 1000 + turn AS place, conv_id % 60 AS k FROM conversations),
h AS (SELECT chapter, handle, min(place) AS place, CASE WHEN min(k) % 12 = 0 AND starts_with(handle, 'user') THEN (min(k) % {POOL})::INT END AS pin,
  list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha1(handle), ''), lambda c: (strpos('{_HEX}', c) - 1)::BIGINT)), lambda a, x: (a * 16 + x) % {POOL})::INT AS pick FROM t GROUP BY chapter, handle),
o AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY place, handle) AS n FROM h),
r AS (SELECT chapter, 0::BIGINT AS n, ''::VARCHAR AS handle, NULL::INT AS voice, []::INT[] AS used FROM (SELECT DISTINCT chapter FROM h)
  UNION ALL SELECT chapter, n, handle, voice, list_distinct(list_append(used, voice)) FROM (
    SELECT r.chapter, o.n, o.handle, r.used, CASE WHEN o.pin IS NOT NULL THEN o.pin WHEN list_contains(r.used, o.pick) AND len(r.used) < {POOL} THEN list_filter(range({POOL}), lambda v: NOT list_contains(r.used, v::INT))[1]::INT ELSE o.pick END AS voice
    FROM r JOIN o ON o.chapter = r.chapter AND o.n = r.n + 1))
SELECT chapter, handle, voice FROM r WHERE n > 0""")
def first_voices(spark, d, pool: int = POOL):
    """The first distinct handles of a chapter have distinct voices; some users are pinned. Here twenty chapters share the conversations."""
    t = turns(spark, d).select((F.col("conv_id") % 20).alias("chapter"), F.concat("speaker", (F.col("conv_id") % 60).cast("string")).alias("handle"), (F.col("conv_id") * 1000 + F.col("turn")).alias("place"), (F.col("conv_id") % 60).alias("k"))
    h = t.groupBy("chapter", "handle").agg(F.min("place").alias("place"), F.min("k").alias("k"))
    pin = F.when((F.col("k") % 12 == 0) & F.col("handle").startswith("user"), (F.col("k") % pool).cast("int"))
    return chat_voices(h.select("chapter", "handle", "place", pin.alias("pin")), "chapter", pool)


@query("joi20_voice_assignment", f"""WITH {_T}, c AS (SELECT conv_id AS speaker, conv_id % 3 AS gender, count(*) AS n FROM turns GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY n DESC, speaker) AS k FROM c WHERE gender < 2),
v AS (SELECT s_suppkey % 2 AS gender, s_name, row_number() OVER (PARTITION BY s_suppkey % 2 ORDER BY s_name) AS k FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT c.speaker, CASE WHEN c.gender = 2 THEN '' ELSE coalesce(v.s_name, 'default') END AS voice FROM c LEFT JOIN r USING (speaker) LEFT JOIN v ON v.gender = r.gender AND v.k = r.k""")
def voice_assignment(spark, d):
    """Speakers by number of lines take the free voices of their gender in turn; unknown gender stays empty, and past the pool's end there is the default."""
    c = turns(spark, d).groupBy(F.col("conv_id").alias("speaker")).agg(F.count("*").alias("n")).withColumn("gender", F.col("speaker") % 3)
    s = table(spark, d, "supplier").where("s_suppkey % 5 <> 0").select((F.col("s_suppkey") % 2).alias("gender"), "s_name")
    pool = s.withColumn("k", F.row_number().over(Window.partitionBy("gender").orderBy("s_name")))
    most = pool.groupBy("gender").agg(F.max("k").alias("most"))
    # only as many speakers as there are voices can have one: they are ranked within slices of the speakers first, so no task sorts all of a gender
    order = [F.col("n").desc(), F.col("speaker")]
    cut = c.join(F.broadcast(most), "gender").withColumn("k", F.row_number().over(Window.partitionBy("gender", F.pmod(F.xxhash64("speaker"), F.lit(64))).orderBy(*order))).where("k <= most")
    ranked = cut.withColumn("k", F.row_number().over(Window.partitionBy("gender").orderBy(*order))).where("k <= most").select("speaker", "gender", "k")
    voiced = ranked.join(pool, ["gender", "k"]).select("speaker", "s_name")
    j = c.join(voiced, "speaker", "left")
    return j.select("speaker", F.when(F.col("gender") == 2, "").otherwise(F.coalesce("s_name", F.lit("default"))).alias("voice"))


@query("joi29_line_voice", f"""WITH {_T}
SELECT conv_id, turn, CASE WHEN length(text) % 7 = 0 THEN 'thought' WHEN speaker = 'system' THEN 'narrator' ELSE coalesce(nullif(CASE WHEN conv_id % 4 = 0 THEN '' ELSE s_name END, ''), 'dialogue') END AS voice
FROM turns LEFT JOIN supplier ON s_suppkey = conv_id % 13""")
def line_voice(spark, d):
    """Thought, mapped speaker (an empty mapping is none), dialogue default, narrator."""
    v = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name").where("k < 13")
    j = turns(spark, d).withColumn("k", F.col("conv_id") % 13).join(v, "k", "left")
    mapped = F.when(F.col("conv_id") % 4 != 0, F.col("s_name"))
    return j.select("conv_id", "turn", F.when(F.length("text") % 7 == 0, "thought").when(F.col("speaker") == "system", "narrator").otherwise(F.coalesce(mapped, F.lit("dialogue"))).alias("voice"))


@query("joi21_effect_merge", f"""WITH {_T}
SELECT conv_id, turn, coalesce(CASE WHEN conv_id % 5 = 0 THEN 1.5 END, CASE WHEN speaker = 'user' THEN 0.5 END, 0.0)::DOUBLE AS pitch, coalesce(CASE WHEN conv_id % 7 = 0 THEN 'robot' END, CASE WHEN speaker = 'assistant' THEN 'warm' END, 'none') AS effect FROM turns""")
def effect_merge(spark, d):
    """Per field, the first that is set: speaker, then voice, then style."""
    pitch = F.coalesce(F.when(F.col("conv_id") % 5 == 0, 1.5), F.when(F.col("speaker") == "user", 0.5), F.lit(0.0))
    effect = F.coalesce(F.when(F.col("conv_id") % 7 == 0, "robot"), F.when(F.col("speaker") == "assistant", "warm"), F.lit("none"))
    return turns(spark, d).select("conv_id", "turn", pitch.alias("pitch"), effect.alias("effect"))


@query("str3_quote_split", """WITH p AS (SELECT doc_id, string_split(text, '"') AS ps FROM documents WHERE contains(text, '"')), q AS (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)
SELECT doc_id, i - 1 AS piece, ps[i] AS body, i % 2 = 0 AS is_quote, CASE WHEN i % 2 = 0 THEN ps[i - 1] END AS pre, CASE WHEN i % 2 = 0 THEN ps[i + 1] END AS post FROM q WHERE ps[i] <> ''""")
def quote_split(spark, d):
    """STR3, JOI26: pieces by parity of the quote marks; a quote has its neighbours as context."""
    p = table(spark, d, "documents").where(F.contains("text", F.lit('"'))).select("doc_id", F.split("text", '"', -1).alias("ps"))
    q = p.select("doc_id", "ps", F.posexplode("ps").alias("piece", "body"))
    is_quote = F.col("piece") % 2 == 1
    return q.where("body <> ''").select("doc_id", F.col("piece").cast("bigint").alias("piece"), "body", is_quote.alias("is_quote"), F.when(is_quote, F.get("ps", F.col("piece") - 1)).alias("pre"), F.when(is_quote, F.get("ps", F.col("piece") + 1)).alias("post"))


@query("win9_speaker_fold")
def speaker_fold(spark, d):
    """Each quote and stretch of narration of a chapter with its speaker: tag, pronoun by gender, subject, last speaker, vocative guard. Blocks are
    paragraphs (SRC2); chapters without a quote are left out before anything is shuffled."""
    text = T.straight_quotes(F.col("text"))
    b = table(spark, d, "documents").where(F.contains(text, F.lit('"'))).select("doc_id", F.posexplode(text_blocks(text)).alias("block_no", "b"))
    return speakers.attribute(b.where("b.kind = 'paragraph'").select("doc_id", "block_no", "b.body"))


# --- the script of chapters that mix prose, boxes and chat


def chapter_blocks(spark, d: str, pool: int = POOL):
    """Conversations as chapters: a heading, then for each turn a bracketed or plain line, typed by its run, and the lines of its text as paragraphs."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "text", F.expr(_LINE_SQL).alias("line"))
    typed = bracket_kinds(t, "conv_id", "turn")
    c = parse_chat(F.col("line"))
    kind = F.when(F.col("typed") == "plain", "paragraph").otherwise(F.col("typed"))
    body = F.when(kind == "chat", c["message"]).when(kind == "system", F.regexp_replace("line", r"^\[+|\]+$", "")).otherwise(F.col("line"))
    chat = kind == "chat"
    block = lambda k, x, u="", p="": F.struct(F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), x.alias("body"), (F.lit(u) if isinstance(u, str) else u).alias("user"), (F.lit(p) if isinstance(p, str) else p).alias("location"))
    texts = F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), lambda x: F.when(T.is_scene_break(x), block("scene_break", F.lit(""))).otherwise(block("paragraph", x)))
    head = F.when(F.col("turn") == 0, F.array(block("heading", F.concat(F.lit("Chapter "), F.col("conv_id").cast("string")))))
    own = F.array(block(kind, body, F.when(chat, c["user"]).otherwise(""), F.when(chat, c["location"]).otherwise("")))
    every = F.concat(F.coalesce(head, F.slice(own, 1, F.lit(0))), own, texts)
    b = typed.select("conv_id", "turn", F.posexplode(every).alias("k", "b")).select("conv_id", (F.col("turn") * 10_000 + F.col("k")).alias("block_no"), "b.*")
    handles = b.where("user <> ''").groupBy("conv_id", F.col("user").alias("handle")).agg(F.min("block_no").alias("place")).withColumn("pin", F.lit(None).cast("int"))
    voices = chat_voices(handles, "conv_id", pool).withColumnRenamed("handle", "user")
    return b.join(voices, ["conv_id", "user"], "left")


_SENT = f"""string_split(regexp_replace(regexp_replace(part, '\\b({"|".join(T.ABBREVIATIONS)})\\.', '\\1\u0002', 'g'), '([.!?…][.!?…"'')\\]]*)[ \\t\\n]*([\\p{{Lu}}"''(\\[])', '\\1{T.CUT}\\2', 'g'), '{T.CUT}')"""
_P = script.PAUSES
SCRIPT_SQL = rf"""l AS (SELECT conv_id, turn, text, role, {_LINE_SQL} AS line FROM conversations),
lk AS (SELECT *, starts_with(line, '[') AS bracket, CASE WHEN NOT starts_with(line, '[') THEN 'paragraph' WHEN starts_with(line, '[Quest') OR starts_with(line, '[System') OR NOT contains(line, ':') THEN 'system' ELSE 'chat' END AS kind, contains(line, '(') AS placed FROM l),
lg AS (SELECT *, count(*) FILTER (NOT bracket) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM lk),
lt AS (SELECT *, CASE WHEN kind = 'chat' AND NOT placed AND count(*) FILTER (kind = 'system') OVER r >= 2 AND count(*) FILTER (kind = 'system') OVER r >= count(*) FILTER (kind = 'chat' AND NOT placed) OVER r THEN 'system' ELSE kind END AS typed FROM lg WINDOW r AS (PARTITION BY conv_id, run)),
tl AS (SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM l),
blocks AS (
  SELECT conv_id, 0 AS block_no, 'heading' AS kind, 'Chapter ' || conv_id AS body, '' AS usr FROM l WHERE turn = 0
  UNION ALL SELECT conv_id, turn * 10000 + (turn = 0)::INT, typed, CASE typed WHEN 'chat' THEN regexp_extract(line, ': (.*)\]$', 1) WHEN 'system' THEN regexp_replace(line, '^\[+|\]+$', '', 'g') ELSE line END, CASE typed WHEN 'chat' THEN regexp_extract(line, '^\[([A-Za-z0-9]+)', 1) ELSE '' END FROM lt
  UNION ALL SELECT conv_id, turn * 10000 + (turn = 0)::INT + i, CASE WHEN brk THEN 'scene_break' ELSE 'paragraph' END, CASE WHEN brk THEN '' ELSE x END, '' FROM (
    SELECT conv_id, turn, i, ls[i] AS x, trim(ls[i]) IN ('***', '* * *', '---', '###', '• • •', '· · ·', '= = =') OR (length(trim(ls[i])) <= 12 AND regexp_matches(trim(ls[i]), '^\s*([*#~•·\-—–_=]\s*){{3,}}\s*$')) AS brk FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM tl))),
handles AS (SELECT conv_id, usr, min(block_no) AS place FROM blocks WHERE usr <> '' GROUP BY ALL),
ho AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place, usr) AS n, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha1(usr), ''), lambda c: (strpos('{_HEX}', c) - 1)::BIGINT)), lambda a, x: (a * 16 + x) % {POOL})::INT AS pick FROM handles),
hr AS (SELECT conv_id, 0::BIGINT AS n, ''::VARCHAR AS usr, NULL::INT AS voice, []::INT[] AS used FROM (SELECT DISTINCT conv_id FROM handles)
  UNION ALL SELECT conv_id, n, usr, voice, list_distinct(list_append(used, voice)) FROM (
    SELECT hr.conv_id, ho.n, ho.usr, hr.used, CASE WHEN list_contains(hr.used, ho.pick) AND len(hr.used) < {POOL} THEN list_filter(range({POOL}), lambda v: NOT list_contains(hr.used, v::INT))[1]::INT ELSE ho.pick END AS voice FROM hr JOIN ho ON ho.conv_id = hr.conv_id AND ho.n = hr.n + 1)),
bv AS (SELECT b.*, 'chat-' || v.voice AS chat_voice, kind = 'chat' AND lag(kind) OVER (PARTITION BY b.conv_id ORDER BY block_no) IS DISTINCT FROM 'chat' AS cue, kind = 'chat' AND row_number() OVER (PARTITION BY b.conv_id, b.usr ORDER BY block_no) = 1 AS fresh
  FROM blocks b LEFT JOIN hr v ON v.conv_id = b.conv_id AND v.usr = b.usr AND v.n > 0),
pt AS (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT *, CASE WHEN kind = 'paragraph' THEN string_split(body, '"') ELSE [body] END AS ps FROM bv WHERE kind IN ('paragraph', 'chat', 'system'))),
st AS (SELECT *, {_SENT} AS cut FROM (SELECT *, ps[i] AS part, kind = 'paragraph' AND i % 2 = 0 AS quote FROM pt) WHERE trim(part) <> ''),
sx AS (SELECT *, trim(replace(cut[k], chr(2), '.')) AS x FROM (SELECT *, unnest(range(1, len(cut) + 1)) AS k FROM st) WHERE trim(cut[k]) <> ''),
sl AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block_no ORDER BY i DESC, k DESC) = 1 AS last FROM sx),
rows AS (
  SELECT conv_id, block_no, 0 AS i, 0 AS k, 'cue' AS kind, 'chat' AS style, '' AS voice, '' AS speaker, 1.1::DOUBLE AS rate, '' AS body, {_P["cue"]} AS pause_ms FROM bv WHERE cue
  UNION ALL SELECT conv_id, block_no, 0, 1, 'speech', 'chat', chat_voice, usr, 1.1, regexp_replace(regexp_replace(usr, '([A-Za-z])([0-9])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), {_P["lead"]} FROM bv WHERE fresh
  UNION ALL SELECT conv_id, block_no, 0, 0, 'speech', 'heading', 'narrator', '', 1.0, body || '.', {_P["scene_break"]} FROM bv WHERE kind = 'heading'
  UNION ALL SELECT conv_id, block_no, 0, 0, 'pause', 'narration', '', '', 1.0, '', {_P["scene_break"]} FROM bv WHERE kind = 'scene_break'
  UNION ALL SELECT conv_id, block_no, i, k, 'speech', CASE WHEN kind = 'chat' THEN 'chat' WHEN kind = 'system' THEN 'system' WHEN quote THEN 'dialogue' ELSE 'narration' END,
    CASE WHEN kind = 'chat' THEN chat_voice WHEN kind = 'system' THEN 'interface' WHEN quote THEN 'dialogue' ELSE 'narrator' END, CASE WHEN kind = 'chat' THEN usr ELSE '' END, CASE kind WHEN 'chat' THEN 1.1::DOUBLE WHEN 'system' THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END, x,
    CASE WHEN kind = 'chat' THEN CASE WHEN last THEN {_P["chat"]} ELSE {_P["sentence"]} END WHEN last THEN {_P["paragraph"]} WHEN quote THEN {_P["dialogue"]} ELSE {_P["sentence"]} END
      + CASE WHEN kind = 'paragraph' AND regexp_matches(x, '(…|\.\.\.)$') THEN {_P["ellipsis"]} ELSE 0 END FROM sl),
script AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY block_no, i, k) - 1 AS seg_no, block_no, CASE WHEN kind = 'speech' AND NOT regexp_matches(body, '[\p{{L}}\p{{N}}]') THEN 'pause' ELSE kind END AS kind, style, voice, speaker, rate::DOUBLE AS rate, body, pause_ms FROM rows)"""


@query("win22_script", f"WITH RECURSIVE {SCRIPT_SQL} SELECT * FROM script")
def chapter_script(spark, d):
    """WIN22, SNK1, AGG18: the script of chapters of all kinds of blocks."""
    flags = {"emphasised": F.lit(False), "machine": F.lit(False)}
    return script.script(chapter_blocks(spark, d).withColumns(flags), "conv_id")


@query("agg18_style_histogram", rf"""WITH RECURSIVE {SCRIPT_SQL} SELECT kind, style, count(*) AS n, sum(length(body))::BIGINT AS n_chars, round(sum(len(list_filter(string_split_regex(body, '\s+'), lambda x: x <> '')) / 2.7 / rate), 3)::DOUBLE AS seconds, sum(pause_ms)::BIGINT AS pause_ms FROM script GROUP BY kind, style""")
def style_histogram(spark, d):
    """Segments and characters of each kind and style, and the seconds they take at 2.7 words a second and their rate."""
    words = F.size(F.array_remove(F.split("body", r"\s+"), ""))
    g = chapter_script(spark, d).groupBy("kind", "style").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("n_chars"), F.sum(words / 2.7 / F.col("rate")).alias("s"), F.sum("pause_ms").alias("pause_ms"))
    return g.select("kind", "style", "n", "n_chars", F.round("s", 3).alias("seconds"), "pause_ms")


@query("snk2_chapter_markdown")
def chapter_markdown(spark, d):
    """SNK2: front matter, headings, boxes, chat lines and paragraphs of each chapter."""
    b = chapter_blocks(spark, d)
    md = script.markdown(F.col("kind"), F.col("body"), F.col("user"), F.col("location"), spans.none())
    parts = F.array_sort(F.collect_list(F.struct("block_no", md.alias("md"))))
    head = F.concat(F.lit("---\ntitle: Chapter "), F.col("conv_id").cast("string"), F.lit("\nstage: parsed\n---\n\n"))
    return b.groupBy("conv_id").agg(parts.alias("p")).select("conv_id", F.concat(head, F.array_join("p.md", "\n\n")).alias("markdown"))
