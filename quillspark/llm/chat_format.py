"""Chat formatting with Spark expressions only.

Turns are collected per conversation as structs and sorted; from the sorted array
each turn gets the number of its run of one role and its place in the formatted
text, by running sums over the conversation; the texts of a run are merged by array
aggregation and its block becomes marked text.  All steps after the first shuffle
stay in its partitions, and work is linear in a conversation's text but for sorting.
A block reads ``<s>role[INST]text[+]text[/INST]</s>`` (``[+]`` parts
the turns that were merged).  Control strings in texts or roles get a backslash
after their first character, and those that have backslashes there already get
one more, so reading back is exact.

The loss mask is a list of ``(start, length)`` spans over the formatted string,
one per turn of a role in ``loss_roles``, on its escaped text only.  Reading cuts
the string at its marks once, so a span is one of the pieces and is found by where
it starts.

Null texts and roles are empty.  Turns sort by turn (null first), then role,
then text; repeated rows stay turns of their own.  Rows with a null conversation
id form one conversation.  A conversation is one row of the result, so its whole
text has to fit one; empty tables give no rows, extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, table


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a block: where it opens, where its texts begin, part and end, where it closes."""

    open: str = "<s>"
    begin: str = "[INST]"
    part: str = "[+]"
    end: str = "[/INST]"
    close: str = "</s>"

    def marks(self) -> list[str]:
        return [self.open, self.begin, self.part, self.end, self.close]

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._mark(), r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._mark(escaped=True), "$1$2$3")

    def _mark(self, escaped: bool = False) -> str:
        """First character, backslashes (but the first, if ``escaped``) and rest of a mark, in three groups."""
        first = "".join("\\" + m[0] for m in self.marks())
        rest = "|".join(rf"\Q{m[1:]}\E" for m in self.marks())
        return rf"([{first}])" + (r"\\" if escaped else "") + rf"(\\*)({rest})"


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",), template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation: ``conv_col, formatted, loss_spans``."""
    t = template
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    sorted_turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    each = sorted_turns.select("conv", F.posexplode("turns").alias("pos", "t")).select("conv", "pos", "t.role", t.escape(F.col("t.text")).alias("text"))
    order = Window.partitionBy("conv").orderBy("pos")
    first = F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(True))
    last = F.coalesce(F.lead("role").over(order) != F.col("role"), F.lit(True))
    head = F.concat(F.lit(t.open), t.escape(F.col("role")), F.lit(t.begin))
    marked = each.withColumns({"first": first, "last": last}).withColumn("before", F.when(F.col("first"), F.length(head)).otherwise(len(t.part)))
    size = F.col("before") + F.length("text") + F.when(F.col("last"), len(t.end + t.close)).otherwise(0)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marked.withColumns({"block": F.sum(F.col("first").cast("int")).over(so_far), "at": F.sum(size).over(so_far) - size + F.col("before")})
    span = F.when(F.col("role").isin(*loss_roles), F.struct(F.col("at").cast("int").alias("start"), F.length("text").alias("length")))
    blocks = placed.groupBy("conv", "block").agg(
        F.any_value(head).alias("head"), F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("texts"), F.array_sort(F.collect_list(span)).alias("spans")
    )
    whole = F.concat("head", F.array_join(F.col("texts.text"), t.part), F.lit(t.end + t.close))
    chats = blocks.select("conv", F.struct("block", whole.alias("piece"), "spans").alias("b")).groupBy("conv").agg(F.sort_array(F.collect_list("b")).alias("b"))
    return chats.select(F.col("conv").alias(conv_col), F.array_join(F.col("b.piece"), "").alias("formatted"), F.flatten("b.spans").alias("loss_spans"))


def read_chats(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Add ``turns``, the array of ``(role, text)`` that the formatted string tells."""
    t = template
    blocks = F.filter(F.split("formatted", rf"\Q{t.close}\E", -1), lambda b: b.startswith(t.open))
    role = lambda b: t.unescape(F.substring_index(F.substring(b, len(t.open) + 1, F.length(b)), t.begin, 1))
    body = lambda b: F.substring_index(F.substring(b, F.instr(b, t.begin) + len(t.begin), F.length(b)), t.end, 1)
    turns = F.flatten(
        F.transform(blocks, lambda b: F.transform(F.split(body(b), rf"\Q{t.part}\E", -1), lambda x: F.struct(role(b).alias("role"), t.unescape(x).alias("text"))))
    )
    return formatted.withColumn("turns", turns)


def masked_texts(chats: DataFrame, id_col: str = "conv_id", template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``(id_col, masked)``: the text under the loss mask of each conversation, unescaped and end to end.

    Marks and what stands between them are the pieces of the string; a piece is
    masked where a span starts at its place and has its length.
    """
    t = template
    mark = "|".join(rf"\Q{m}\E" for m in t.marks())
    pieces = chats.select(F.col(id_col).alias("conv"), "loss_spans", F.posexplode(F.split("formatted", rf"(?={mark})|(?<={mark})", -1)).alias("pos", "piece"))
    order = Window.partitionBy("conv").orderBy("pos")
    start = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("piece")
    placed = pieces.drop("loss_spans").withColumn("start", start.cast("int"))
    spans = chats.select(F.col(id_col).alias("own"), F.explode("loss_spans").alias("s")).select("own", "s.start", "s.length").where("length > 0")
    hit = placed.join(spans, F.col("conv").eqNullSafe(F.col("own")) & (placed["start"] == spans["start"]) & (F.length("piece") == F.col("length")))
    said = hit.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", t.unescape(F.col("piece")).alias("text")))).alias("said"))
    return said.select(F.col("conv").alias(id_col), F.array_join(F.col("said.text"), "").alias("masked"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted, written out, and digested as they are read back."""
    columns = ["conv_id", "turn", "role", "text"]
    rows = table(spark, sf_dir, "conversations").select(*columns)
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    chats = materialize(format_chats(rows.unionByName(own)), "chats")
    masks = masked_texts(chats).withColumnRenamed("conv_id", "own")
    read = read_chats(chats).join(masks, F.col("conv_id").eqNullSafe(F.col("own")), "left").withColumn("masked", F.coalesce("masked", F.lit("")))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"length(regexp_replace({}, '([<\[])(\\*)(s>|INST\]|\+\]|/INST\]|/s>)', '\1\\\2\3', 'g'))"
OP9_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
o AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (
  SELECT *, {_ESCAPED.format("text")} + CASE WHEN before = role THEN 3 ELSE {_ESCAPED.format("role")} + 20 END AS size FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
