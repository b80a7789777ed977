"""Chat formatting by event sourcing: logs are sorted by sequence, folded into final messages, then rendered.

Event kinds: ``start`` opens a turn with its role, ``delta`` appends text, ``edit`` replaces the turn's text,
``regenerate`` clears it so that later deltas write it anew. An edit or regeneration also discards every later turn, as
chat clients do. All steps are DataFrame expressions.

Template: each turn is ``<s>[INST:role] text [/INST]</s>`` and a line feed. Inside texts a backslash is doubled and each
control string gets one after its first character (``<\\s>``, ``[\\INST``), so no control string of a text survives and
``unescape`` gives the text back. Roles are URL-encoded in the marker.

Defined results: null text is empty, null role an empty role, null turn sorts first; turns with equal number are
separate messages in the order of role, then text; a conversation without turns has no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELTA_CHARS = 2048
EVENT_FIELDS = ["conv_id", "seq", "msg", "kind", "role", "text"]
# The control strings of the template.
OPEN, CLOSE, END = "<s>[INST:", " [/INST]", "</s>\n"
_TURN = r"(?s)<s>\[INST:([^\]]*)\] (.*?) \[/INST\]</s>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, r"<(/?s>)", r"<\\$1"), r"\[(/?INST)", r"[\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_of(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """A log of start and delta events for stored conversations; ``seq`` is an array that sorts as the events happened."""
    text = F.coalesce("text", F.lit(""))
    parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{delta_chars}}}"), F.lit(0))
    # equal turns are told apart by role and text digest; wholly repeated rows by their number
    base = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    base = base.withColumn("n", F.row_number().over(same))
    msg = F.struct(F.col("turn"), F.col("n"))
    start = F.struct(F.lit(0).alias("part"), F.lit("start").alias("kind"), F.lit("").alias("text"))
    deltas = F.transform(parts, lambda x, i: F.struct((i + 1).alias("part"), F.lit("delta").alias("kind"), x.alias("text")))
    rows = base.select("conv_id", "role", msg.alias("msg"), F.explode(F.concat(F.array(start), deltas)).alias("e"))
    return rows.select("conv_id", F.struct("msg", "e.part").alias("seq"), "msg", "e.kind", F.when(F.col("e.kind") == "start", F.col("role")).alias("role"), "e.text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, seq, msg, kind, role, text) events -> one row a surviving message: conv_id, msg, role, text.

    Two running aggregates over a conversation sorted by sequence find what later edits and regenerations discard; they
    keep one value each, so a conversation of any length streams through. Repeated events apply as often as they occur.
    """
    later = Window.partitionBy("conv_id").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reset = F.when(F.col("kind").isin("edit", "regenerate"), F.col("msg"))
    cut = F.min(reset).over(later)  # the earliest message that is reset later
    live = events.withColumn("cut", cut).where("cut IS NULL OR msg < cut OR msg = cut AND kind = 'start'")  # a reset keeps its turn's role
    piece = F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "")
    return live.groupBy("conv_id", "msg").agg(F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"), whole.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text) -> conv_id, formatted, loss_spans: half-open code-point ranges of assistant texts."""
    role = F.coalesce("role", F.lit(""))
    body = escape(F.col("text"))
    head = F.concat(F.lit(OPEN), F.url_encode(role), F.lit("] "))
    m = messages.select("conv_id", "msg", F.concat(head, body, F.lit(CLOSE + END)).alias("s"), F.length(head).alias("h"), F.length(body).alias("b"), (role == "assistant").alias("loss"))
    so_far = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("s").cast("long")).over(so_far), F.lit(0)) + F.col("h")
    m = m.withColumn("start", begin).withColumn("span", F.when(F.col("loss"), F.struct("start", (F.col("start") + F.col("b")).alias("end"))))
    turns = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg", "s", "span"))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["span"].isNotNull()), lambda x: x["span"])
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def under_mask(formatted: DataFrame) -> DataFrame:
    """Adds loss_texts: the unescaped texts that ``loss_spans`` covers, cut from ``formatted`` in one pass over its turns."""
    zero = F.expr("cast(named_struct('at', 0, 'j', 0, 'out', array()) as struct<at:bigint,j:int,out:array<string>>)")

    def step(acc, chunk):
        span = F.get("loss_spans", acc["j"])
        here = F.coalesce(span["start"] < acc["at"] + F.length(chunk), F.lit(False))
        text = unescape(F.substr(chunk, (span["start"] - acc["at"] + 1).cast("int"), (span["end"] - span["start"]).cast("int")))
        out = F.when(here, F.concat(acc["out"], F.array(text))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(chunk)).alias("at"), (acc["j"] + here.cast("int")).alias("j"), out.alias("out"))

    chunks = F.split("formatted", r"(?<=</s>\n)")
    return formatted.withColumn("loss_texts", F.aggregate(chunks, zero, step)["out"])


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role,text>> parsed from ``formatted`` alone."""
    pick = lambda g: F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(g))
    turns = F.transform(F.arrays_zip(pick(1).alias("r"), pick(2).alias("t")), lambda x: F.struct(F.url_decode(x["r"]).alias("role"), unescape(x["t"]).alias("text")))
    return formatted.select("*", turns.alias("turns"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    return render(fold(events_of(conversations)))


def op4(spark, sf_dir: str) -> DataFrame:
    from landgrid.llm._util import table

    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn int, role string, text string")
    out = under_mask(read_back(format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))))
    joined = lambda f, c="turns": F.array_join(F.transform(c, f), "")
    all_turns = joined(lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, x.turn, x.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
             regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST)', '[\\\1', 'g') AS esc FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(esc) + length(role) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
