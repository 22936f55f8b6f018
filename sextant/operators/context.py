"""Context packing: ranked results under item and byte limits, always with whole citations.

An item is a numbered block: title, snippet, citation. The budget runs through the ranked
items of a query (at most ``MOST_ITEMS``), as an aggregate over their array: built-in
expressions only. A snippet that does not fit is cut at the last character whose bytes do
and marked; an item whose citation does not fit ends the context.

Defined results: no results, no row; a null snippet or title is an empty one (an empty
title shows the concept's id); citations without a commit, or of several revisions, are an
error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact

METHOD = "utf8-bytes-v1"
MOST_ITEMS = 20
GAP, MARK = "\n\n", "…"
_ITEMS = "array<struct<concept_id:string,title:string,snippet:string,path:string>>"


def _head(number: Column, item: Column) -> Column:
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), item["label"], F.lit("\n"))


def fitting(text: Column, room: Column) -> Column:
    """The most leading characters of a text that take at most ``room`` bytes, without a space at the end.

    A character has one to four bytes: lengths below a quarter of the room need no look.
    """
    room = F.greatest(room, F.lit(0)).cast("int")
    lengths = F.sequence(F.least(F.length(text), F.floor(room / 4).cast("int")), F.least(F.length(text), room))
    most = F.array_max(F.filter(lengths, lambda n: F.octet_length(F.left(text, n)) <= room))
    return F.rtrim(F.left(text, F.coalesce(most, F.lit(0))))


def pack(results: DataFrame, max_items: int, max_bytes: int) -> DataFrame:
    """items, context, used, truncated per qid of ranked results.

    results: qid, rank, concept_id, title, snippet, path, index_revision, bundle_commit, total.
    """
    if max_items < 1 or max_bytes < 1:
        raise ValueError("context bounds must be positive")
    title, snippet = compact(F.col("title")), compact(F.col("snippet"))
    citation = F.concat(F.lit("\ncitation: concept_id="), "concept_id", F.lit("; path="), "path", F.lit("; bundle_commit="), "bundle_commit", F.lit("; index_revision="), "index_revision")
    item = F.struct("rank", "concept_id", "title", "path", F.when(title == "", F.col("concept_id")).otherwise(title).alias("label"), snippet.alias("text"), citation.alias("citation"))
    commits = F.count_distinct(F.struct("index_revision", "bundle_commit"))
    rows = results.where(F.col("rank") <= min(max_items, MOST_ITEMS)).groupBy("qid").agg(
        F.array_sort(F.collect_list(item)).alias("ranked"), F.max("total").alias("total"), (commits > 1).alias("mixed"), (F.count("bundle_commit") < F.count("*")).alias("uncommitted"),
    )
    ranked = F.when(F.col("mixed") | F.col("uncommitted"), F.raise_error(F.lit("citations name no commit or several revisions"))).otherwise(F.col("ranked"))
    start = F.struct(F.array().cast(_ITEMS).alias("items"), F.lit("").alias("context"), F.lit(False).alias("cut"), F.lit(False).alias("full"))

    def add(state: Column, x: Column) -> Column:
        before = F.when(F.size(state["items"]) > 0, F.concat(state["context"], F.lit(GAP))).otherwise(F.lit(""))
        head = _head(F.size(state["items"]) + 1, x)
        room = F.lit(max_bytes) - F.octet_length(F.concat(before, head, x["citation"]))  # bytes left for the snippet
        whole = F.octet_length(x["text"]) <= room
        marked = room - len(MARK.encode())
        text = F.when(whole, x["text"]).when(marked >= 0, F.concat(fitting(x["text"], marked), F.lit(MARK))).otherwise("")
        entry = F.struct(x["concept_id"].alias("concept_id"), x["title"].alias("title"), text.alias("snippet"), x["path"].alias("path"))
        more = F.struct(F.concat(state["items"], F.array(entry)).alias("items"), F.concat(before, head, text, x["citation"]).alias("context"), (state["cut"] | ~whole).alias("cut"), F.lit(False).alias("full"))
        return F.when(state["full"] | (room < 0), F.struct(state["items"].alias("items"), state["context"].alias("context"), state["cut"].alias("cut"), F.lit(True).alias("full"))).otherwise(more)

    packed = rows.select("qid", "total", F.aggregate(ranked, start, add).alias("p"))
    return packed.select("qid", "p.items", "p.context", F.octet_length("p.context").alias("used"), (F.col("p.cut") | (F.col("total") > F.size("p.items"))).alias("truncated"))
