r"""Chat formatting from an event log.

A conversation's log holds events (conv_id, seq, kind, target, role, text):

* ``message`` starts a message at its seq, with a first piece of text;
* ``delta`` appends text to the message whose seq is ``target``;
* ``edit`` replaces that message's text;
* ``regenerate`` empties it, for the deltas that follow, and takes back every
  message that was started after it and before the event.

The fold is relational: the pieces of one message come together with the last
event that reset it, messages are taken back by comparing with the last
regeneration of an earlier message, and only the final, already rendered turns
of a conversation meet, in the order of seq.

A turn is rendered as ``### role: text</turn>\n``. Inside roles and texts
``\`` becomes ``\b``, ``###`` becomes ``\h`` and ``</turn>`` becomes ``\t`` (in
roles also ``:`` becomes ``\c``), so that neither mark occurs in a text and the
escape can be undone. The loss mask lists, for each assistant turn, the part of
its rendered piece that is the text.

Defined cases: null texts and roles are empty; a null seq sorts first; messages
with equal seq are separate turns ordered by role and text; changes of a
message that does not exist are left out; an empty log gives an empty result;
other columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark._util import with_once
from shelfmark.llm.common import pick

END = "</turn>\n"
HEAD = "### "
ASSISTANT = "assistant"
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.replace(out, F.lit("###"), F.lit("\\h"))
    return F.replace(out, F.lit("</turn>"), F.lit("\\t"))


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\t"), F.lit("</turn>"))
    out = F.replace(out, F.lit("\\h"), F.lit("###"))
    out = F.replace(out, F.lit("\\c"), F.lit(":"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


#: Events of a turn are at most so many; the next turn's message comes after them.
EVENTS = 8


def as_log(turns: DataFrame) -> DataFrame:
    """The log of events that writing the rows (conv_id, turn, role, text) in the order of ``turn`` leaves behind.

    Every fourth turn of a conversation is sent as a whole; one comes in two
    pieces, one is typed, goes on and is edited, one is answered, regenerated
    (what was answered goes with it) and streamed anew. Folding the log gives
    the rows back. Rows with equal turns follow in the order of role and text.
    """
    rows = pick(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("role", F.coalesce("role", F.lit("")))
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("n", F.row_number().over(place).cast("bigint"))
    half = F.floor(F.length("text") / 2).cast("int")
    head, tail = F.substring("text", F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))

    def event(at: int, kind: str, text: Column) -> Column:
        return F.struct(F.lit(at).alias("at"), F.lit(kind).alias("kind"), text.alias("text"))

    none = F.lit("")
    events = (F.when(F.col("n") % 4 == 0, F.array(event(0, "message", F.col("text"))))
              .when(F.col("n") % 4 == 1, F.array(event(0, "message", head), event(1, "delta", tail)))
              .when(F.col("n") % 4 == 2, F.array(event(0, "message", tail), event(1, "delta", head), event(2, "edit", F.col("text"))))
              .otherwise(F.array(event(0, "message", tail), event(1, "message", head), event(2, "regenerate", none),
                                 event(3, "delta", head), event(4, "delta", tail))))
    log = rows.select("conv_id", "n", "role", F.explode(events).alias("e"))
    started = F.col("e.kind") == "message"
    return log.select("conv_id", (F.col("n") * EVENTS + F.col("e.at")).alias("seq"), "e.kind",
                      F.when(~started, F.col("n") * EVENTS).alias("target"), F.when(started, F.col("role")).alias("role"), "e.text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text) of the messages that stand at the end of the log."""
    log = pick(events, conv_id="conv_id", seq="seq", kind="kind", target="target", role="role", text="text")
    log = log.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("role", F.coalesce("role", F.lit("")))
    messages = log.filter("kind = 'message'").select("conv_id", "seq", "role", "text")
    changes = log.filter("kind in ('delta', 'edit', 'regenerate')")
    reset = F.col("kind") != "delta"
    per = changes.groupBy("conv_id", F.col("target").alias("seq")).agg(
        F.max(F.when(reset, F.col("seq"))).alias("reset_at"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again_at"),
        F.sort_array(F.collect_list(F.struct("seq", (F.col("kind") == "edit").alias("edit"), "text"))).alias("pieces"))
    on = messages["conv_id"].eqNullSafe(per["conv_id"]) & (messages["seq"] == per["seq"])
    both = messages.join(per, on, "left").select(messages["conv_id"], messages["seq"], "role", "text", "reset_at", "again_at", "pieces")
    # Pieces after the last reset; an edit brings the text itself, a regeneration none.
    live = F.filter("pieces", lambda p: F.col("reset_at").isNull() | (p["seq"] > F.col("reset_at")) | ((p["seq"] == F.col("reset_at")) & p["edit"]))
    text = F.concat(F.when(F.col("reset_at").isNull(), F.col("text")).otherwise(""),
                    F.coalesce(F.array_join(F.transform(live, lambda p: p["text"]), ""), F.lit("")))
    both = both.withColumn("text", text)
    # The last regeneration of a message started earlier takes back what was started before that event.
    earlier = Window.partitionBy("conv_id").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    regenerated = changes.filter("kind = 'regenerate'").select("conv_id").distinct().withColumn("again", F.lit(True))
    marked = both.join(regenerated.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    calm = marked.filter("again is null").select("conv_id", "seq", "role", "text")
    moved = (marked.filter("again").withColumn("gone_at", F.max("again_at").over(earlier))
             .filter("gone_at is null or seq > gone_at").select("conv_id", "seq", "role", "text"))
    return calm.unionByName(moved)


def render(messages: DataFrame, loss_role: str = ASSISTANT) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans): spans are (turn, start, length) in code points of the turn's piece."""
    rows = pick(messages, conv_id="conv_id", seq="seq", role="role", text="text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(HEAD), F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit(": "))
    rows = rows.select("conv_id", F.struct("seq", role.alias("role"), text.alias("text")).alias("order"),
                       head.alias("head"), escape(text).alias("body"))
    turn = F.struct(F.col("order"), F.concat("head", "body").alias("piece"), F.length("head").alias("start"), F.length("body").alias("length"))
    per = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t, i: F.when(t["order"]["role"] == loss_role, F.struct(
        i.alias("turn"), t["start"].alias("start"), t["length"].alias("length")))), lambda s: s.isNotNull())
    return per.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                      F.array_join(F.transform("turns", lambda t: F.concat(t["piece"], F.lit(END))), "").alias("formatted"),
                      spans.alias("loss_spans"))


def format_log(events: DataFrame, loss_role: str = ASSISTANT) -> DataFrame:
    """The folded log of every conversation, rendered."""
    return render(fold(events), loss_role)


def parse(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>, loss array<string>) read back from formatted texts and masks."""
    pieces = F.split("formatted", END)
    df = with_once(formatted.select("conv_id", "formatted", "loss_spans"), F.slice(pieces, F.lit(1), F.size(pieces) - 1), "pieces")

    def read(p: Column) -> Column:
        rest = F.substring(p, F.lit(len(HEAD) + 1), F.length(p))
        at = F.instr(rest, ": ")
        return F.struct(unescape(F.substring(rest, F.lit(1), at - 1)).alias("role"),
                        unescape(F.substring(rest, at + 2, F.length(rest))).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.get("pieces", s["turn"]), s["start"] + 1, s["length"])))
    return df.select("conv_id", "formatted", F.transform("pieces", read).alias("turns"), loss.alias("loss"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of what ``parse`` reads back."""
    df = parse(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    df = with_once(df, F.array_join("loss", ""), "learned")
    return df.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                     F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                     F.length("formatted").cast("bigint").alias("formatted_chars"))


#: DuckDB SQL for the query's columns.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, x.turn, x.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(turn, role)),
e AS (
  SELECT *, length('### ') + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c')) + 2
    + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) + 8 AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
