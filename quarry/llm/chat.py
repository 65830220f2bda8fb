"""Chat formatting from an event log, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import staged

#: The template's control strings. A turn is <s>ROLE[INST]TEXT[/INST]</s>.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_REST = r"(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    r"""Puts a backslash behind the first character of each control string in a text.

    A control string whose first character already has backslashes behind it gets one
    more, so unescape() is an exact inverse and no control string is left.
    """
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2$3")


def fold_events(events: DataFrame, id_cols: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """Final messages of a log: id_cols, message, position, role, text.

    events: id_cols, seq, kind, message, role, text; other columns are ignored. The events
    of a conversation count in the order of (seq, message, kind, text, role). kind:
      message     sets a message's whole text
      delta       appends to a message's text
      edit        replaces a message's text; later messages stay
      regenerate  restarts a message where it stands: its earlier events go, and so do all
                  messages that stand after it
      delete      takes a message away, unless later events set it anew
    Unknown and null kinds count as message. A message stands where its first live event
    does; one that comes again after it was deleted or dropped is a new one there. Its role
    is that of the first live event that has one. Null text is empty, a null seq comes
    first, a null conversation or message id is a value like others, repeated rows all
    count; an empty log gives no rows.

    Each step is a window or a grouping by conversation on one shuffle. What a
    regeneration drops depends on where its message stood at that moment; that takes one
    fold over the regenerations of a conversation and the events between them that may
    begin a regenerated message (one for each message and gap): an array of one
    conversation, as its rendered text is. Logs without regenerations skip it.
    """
    ids = list(id_cols)
    log = events.select(
        *ids,
        "message",
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("kind").isin("delta", "edit", "regenerate", "delete"), F.col("kind")).otherwise("message").alias("kind"),
        "seq",
    )
    order = [F.col("seq").asc_nulls_first(), F.col("message").asc_nulls_first(), F.col("kind"), F.col("text"), F.col("role")]
    conv = Window.partitionBy(*ids)
    one = Window.partitionBy(*ids, "message")
    again = events.where("kind = 'regenerate'").limit(1).count() > 0
    if again:
        # numbered once and written, as both the fold and the windows go by the number
        log = staged(log.withColumn("at", F.row_number().over(conv.orderBy(*order)).cast("long")), "chat-log")
        log = _with_cuts(log, ids)
        later = conv.orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
        # no later regeneration drops what begins here
        stays = F.coalesce(F.min("cut").over(later) > F.col("at"), F.lit(True))
    else:
        log = log.withColumn("at", F.row_number().over(conv.orderBy(*order)).cast("long"))
        stays = F.lit(True)
    log = log.withColumn("stays", stays)
    log = log.withColumn("deleted", F.max(F.when(F.col("kind") == "delete", F.col("at"))).over(one))
    log = log.where(F.col("deleted").isNull() | (F.col("at") > F.col("deleted")))
    log = log.withColumn("start", F.min(F.when(F.col("stays"), F.col("at"))).over(one)).where(F.col("at") >= F.col("start"))
    # the last event that sets a message anew hides the text before it
    log = log.withColumn("base", F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(one))
    log = log.withColumn("who", F.min_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).over(one))
    log = log.where(F.col("base").isNull() | (F.col("at") >= F.col("base")))
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    return log.groupBy(*ids, "message", "start", "who").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")).select(*ids, "message", F.col("start").alias("position"), F.col("who").alias("role"), "text")


def _with_cuts(log: DataFrame, ids: list[str]) -> DataFrame:
    """Adds cut to the regenerations: where their message stood; what stands there or
    later goes. Of other events it is null."""
    one = Window.partitionBy(*ids, "message")
    turn = F.col("kind") == "regenerate"
    gaps = F.count_if(turn).over(Window.partitionBy(*ids).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    marked = log.select(*ids, "at", "message", "kind").withColumn("turns", F.count_if(turn).over(one)).withColumn("gap", gaps).where("turns > 0")
    marked = marked.withColumn("gone", F.count_if(F.col("kind") == "delete").over(one.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)))
    first = F.row_number().over(Window.partitionBy(*ids, "message", "gap", "gone").orderBy("at")) == 1
    marked = marked.withColumn("first", first).where(F.col("first") | F.col("kind").isin("regenerate", "delete"))
    steps = F.array_sort(F.collect_list(F.struct("at", "kind", "message")))
    kind = dict(log.dtypes)["message"]
    empty = F.struct(F.array().cast(f"array<struct<message:{kind},start:bigint>>").alias("live"), F.array().cast("array<struct<at:bigint,cut:bigint>>").alias("cuts"))

    def step(state, e):
        mine = lambda x: x["message"].eqNullSafe(e["message"])
        start = F.coalesce(F.get(F.filter(state["live"], mine), F.lit(0))["start"], e["at"])
        new = F.array(F.struct(e["message"].alias("message"), e["at"].alias("start")))
        turned = F.concat(F.filter(state["live"], lambda x: x["start"] < start), new)
        begun = F.when(F.exists(state["live"], mine), state["live"]).otherwise(F.concat(state["live"], new))
        live = F.when(e["kind"] == "regenerate", turned).when(e["kind"] == "delete", F.filter(state["live"], lambda x: ~mine(x))).otherwise(begun)
        cuts = F.when(e["kind"] == "regenerate", F.concat(state["cuts"], F.array(F.struct(e["at"].alias("at"), start.alias("cut"))))).otherwise(state["cuts"])
        return F.struct(live.alias("live"), cuts.alias("cuts"))

    folded = marked.groupBy(*ids).agg(steps.alias("steps")).select(*ids, F.aggregate("steps", empty, step)["cuts"].alias("cuts"))
    cuts = folded.select(*[F.col(c).alias(f"{c}_of_cut") for c in ids], F.inline("cuts")).withColumnRenamed("at", "at_of_cut")
    same = F.col("at") == F.col("at_of_cut")
    for c in ids:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of_cut"))
    return log.join(cuts, same, "left").select(*log.columns, "cut")


def format_chat(messages: DataFrame, id_cols: tuple[str, ...] = ("conv_id",), loss_role: str = "assistant") -> DataFrame:
    """Renders final messages: id_cols, formatted, loss_spans, n_turns.

    Turns stand in the order of (position, message). Roles and texts are escaped. Null
    role or text is empty. loss_spans: array<struct<start, length>> in code points,
    the rendered texts of loss_role. The whole conversation is one value of the result,
    so its size (2 GB at most in Spark) bounds what a task holds.
    """
    ids = list(id_cols)
    head = F.concat(F.lit("<s>"), escape(F.coalesce("role", F.lit(""))), F.lit("[INST]"))
    body = escape(F.coalesce("text", F.lit("")))
    turns = messages.select(*ids, "position", "message", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), body.alias("body"))
    size = F.length("head") + F.length("body") + F.lit(len("[/INST]</s>"))
    before = Window.partitionBy(*ids).orderBy("position", F.col("message").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("end", F.sum(size).over(before))
    start = F.col("end") - F.lit(len("[/INST]</s>")) - F.length("body")
    turns = turns.withColumn("span", F.when(F.col("role") == loss_role, F.struct(start.alias("start"), F.length("body").cast("long").alias("length"))))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit("[/INST]</s>")))
    got = turns.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("end", "turn", "span"))).alias("turns"))
    return got.select(
        *ids,
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.size("turns").cast("long").alias("n_turns"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a rendered conversation: array<struct<role, text>>."""
    ended = F.split(formatted, "</s>", -1)
    parts = F.transform(F.slice(ended, 1, F.size(ended) - 1), lambda t: F.split(t, r"\[/?INST\]", -1))
    return F.transform(parts, lambda p: F.struct(unescape(F.substring(p[0], 4, 2**31 - 1)).alias("role"), unescape(p[1]).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chat_query(conversations: DataFrame) -> DataFrame:
    """The digests of every conversation of a table (conv_id, turn, role, text) and of
    conversation -7, read back from the rendered output."""
    added = conversations.sparkSession.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(added)
    # a row is a turn of its own, rows that repeat a turn too
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    events = rows.withColumn("seq", n).withColumn("message", F.col("seq")).withColumn("kind", F.lit("delta"))
    out = format_chat(fold_events(events))
    turns = read_turns(F.col("formatted"))
    out = out.select(
        "conv_id",
        F.col("formatted"),
        turns.alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(20 + length(role) + length(text)
           + len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?INST\])'))
           + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\])')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
