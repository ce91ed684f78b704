"""Chunks of documents, pages and question-answer pairs.

Pieces (paragraphs, or sentences of long paragraphs) come from column
expressions with their token estimates; the greedy packing with its running sum
is one array fold, and the overlap reads the previous chunk.  No Python runs.
Values that are used more than once are bound by ``_let``, as Spark evaluates a
repeated expression inside array functions each time: work stays linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import collapse_space, estimate_tokens, split_paragraphs, split_sentences, trim_space

# Tokens of a chunk aimed at, at most, at least, and repeated from the one before.
TARGET, LARGEST, SMALLEST, OVERLAP = 300, 450, 40, 50

PIECES = "array<struct<text: string, tokens: int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunk(text: Column) -> Column:
    return F.struct(text.alias("text"), estimate_tokens(text).cast("int").alias("tokens"))


def _packed(pieces: Column, joint: str) -> Column:
    """Greedy fold: a piece joins the open chunk while the sum stays within the target."""
    empty = F.struct(F.array().cast(PIECES).alias("done"), F.lit("").alias("text"), F.lit(0).alias("tokens"))

    def step(s: Column, p: Column) -> Column:
        full = (s["text"] != "") & (s["tokens"] + p["tokens"] > TARGET)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(F.struct(s["text"].alias("text"), s["tokens"].alias("tokens"))))).otherwise(s["done"]).alias("done"),
            F.when(full | (s["text"] == ""), p["text"]).otherwise(F.concat(s["text"], F.lit(joint), p["text"])).alias("text"),
            F.when(full, p["tokens"]).otherwise(s["tokens"] + p["tokens"]).alias("tokens"),
        )

    def finish(s: Column) -> Column:
        return F.when(s["text"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["text"].alias("text"), s["tokens"].alias("tokens")))))

    return F.aggregate(pieces, empty, step, finish)


def _measured(texts: Column) -> Column:
    return F.transform(texts, _chunk)


def text_pieces(text: Column) -> Column:
    """Paragraphs with token estimates; those over the limit as runs of their sentences."""
    split_up = lambda p: F.when(p["tokens"] > LARGEST, _measured(F.transform(_packed(_measured(split_sentences(p["text"])), " "), lambda x: x["text"]))).otherwise(F.array(p))
    return F.flatten(F.transform(_measured(split_paragraphs(text)), split_up))


def _tail_merged(chunks: Column) -> Column:
    """A last chunk below the least size goes back into the one before, which is measured anew."""

    def merged(c: Column) -> Column:
        n = F.size(c)
        last, before = F.get(c, n - 1), F.get(c, n - 2)
        both = _let(F.concat(before["text"], F.lit("\n\n"), last["text"]), _chunk)
        return F.when((n > 1) & (last["tokens"] < SMALLEST), F.concat(F.slice(c, 1, F.greatest(n - 2, F.lit(0))), F.array(both))).otherwise(c)

    return _let(chunks, merged)


def last_tokens(text: Column, most: int = OVERLAP) -> Column:
    """Trailing sentences of at most ``most`` tokens in all, the last one always."""
    back = F.reverse(split_sentences(text))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("tokens"), F.lit(True).alias("open"))

    def step(s: Column, x: Column) -> Column:
        def taken(tokens: Column) -> Column:
            fits = (F.size(s["kept"]) == 0) | (s["tokens"] + tokens <= most)
            more = F.struct(F.concat(F.array(x), s["kept"]).alias("kept"), (s["tokens"] + tokens).cast("int").alias("tokens"), F.lit(True).alias("open"))
            return F.when(fits, more).otherwise(F.struct(s["kept"].alias("kept"), s["tokens"].alias("tokens"), F.lit(False).alias("open")))

        return F.when(s["open"], _let(estimate_tokens(x), taken)).otherwise(s)

    return F.aggregate(back, start, step, lambda s: F.array_join(s["kept"], " "))


def _overlapped(chunks: Column) -> Column:
    """Every chunk but the first after the end of the one before, as it was without its own overlap, and measured anew."""

    def one(c: Column, x: Column, i: Column) -> Column:
        joined = lambda tail: F.when(tail == "", x["text"]).otherwise(F.concat(tail, F.lit("\n\n"), x["text"]))
        return F.when(i == 0, x).otherwise(_let(_let(last_tokens(F.get(c, i - 1)["text"]), joined), _chunk))

    return _let(chunks, lambda c: F.transform(c, lambda x, i: one(c, x, i)))


def chunk_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, position, text, est_tokens)``, one row per chunk; blank documents give none."""
    steps = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("__text")).withColumn("__pieces", text_pieces(F.col("__text")))
    packed = steps.withColumn("__packed", _tail_merged(_packed(F.col("__pieces"), "\n\n")))
    whole = packed.withColumn("__chunks", _overlapped(F.col("__packed")))
    # The outer form: for the inner one Spark filters by the size of the array first and builds it twice.
    rows = whole.select(F.col(id_col), F.posexplode_outer("__chunks").alias("position", "c")).where("position is not null")
    return rows.select(id_col, "position", "c.text", F.col("c.tokens").alias("est_tokens"))


def chunk_pairs(pairs: DataFrame, id_col: str, pairs_col: str) -> DataFrame:
    """One chunk per question-answer pair, never merged; pairs empty on both sides are skipped, positions stay dense."""
    text = lambda p: trim_space(F.concat_ws("\n", trim_space(F.coalesce(p["question"], F.lit(""))), trim_space(F.coalesce(p["answer"], F.lit("")))))
    kept = F.filter(F.transform(F.col(pairs_col), text), lambda t: t != "")
    return pairs.select(F.col(id_col), F.posexplode_outer(kept).alias("position", "text")).where("position is not null").withColumn("est_tokens", estimate_tokens(F.col("text")))


def titled_chunks(chunks: DataFrame, site_col: str, page_col: str, title_col: str) -> DataFrame:
    """Chunks of a site's pages under their titles, with positions that run on across pages (a site, of at most 200 crawled pages, is numbered by one task)."""
    title = collapse_space(F.coalesce(title_col, F.lit("")))
    text = F.when(title == "", F.col("text")).otherwise(F.concat(title, F.lit("\n\n"), F.col("text")))
    return chunks.withColumn("text", text).withColumn("position", F.expr(f"row_number() OVER (PARTITION BY {site_col} ORDER BY {page_col}, position) - 1"))
