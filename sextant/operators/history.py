"""Commit history as a table of edges: prefixes resolved, ancestry decided, notes judged against an export.

A history is a table commits (id, n, parent): a row a parent, n its place (0 first), and one
row with a null parent for a commit without any. A parent that has no row of its own is
where the known history ends. A column serial may be added: a number of the commit that
is larger than those of its parents (it is checked, and not used where that does not hold).

Ancestry is decided on chains. A chain follows first parents, and of several commits with
one first parent one goes on with its chain; so every commit has a chain and a
place on it, found by pointer doubling in as many rounds as the logarithm of the longest
chain. What a commit reaches is one place a chain: it moves to another chain only where an
edge leaves, and everything below a reached place is reached. A round of the frontier is a
hop between chains, however long they are; where few edges leave chains, each task walks them.
Ids are numbered once, so that the rounds move numbers.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .evaluate import freshness

#: The fewest digits by which a commit may be named.
SHORTEST = 4
#: Edges between chains that every task may hold, at about 100 bytes each.
FEW_EDGES = 200_000
#: Digits by which longer names are looked up.
LONG = 8
#: The number of parents that are not in the history, and of their chain.
_BEYOND = -1


def resolve(refs: DataFrame, commits: DataFrame, ref: str = "ref") -> DataFrame:
    """Each distinct ``ref`` and ``commit``: the one whose id begins with it, null if there is none or several."""
    digits = F.lower(ref)
    named = refs.select(ref).distinct().select(ref, F.when(F.regexp_like(ref, F.lit(r"\A[0-9a-fA-F]{%d,64}\z" % SHORTEST)), digits).alias("_d"))
    named, ids = stored(named), commits.select("id").distinct()
    least = lambda rows, n: rows.join(ids, (F.substring("_d", 1, n) == F.substring("id", 1, n)) & F.col("id").startswith(F.col("_d")), "left")
    long, short = F.coalesce(F.length("_d") >= LONG, F.lit(False)), named.where(F.coalesce(F.length("_d") < LONG, F.lit(True)))
    found = least(named.where(long), LONG)
    if not short.isEmpty():
        found = found.unionByName(least(short, SHORTEST))
    return found.groupBy(ref).agg(F.count("id").alias("_n"), F.min("id").alias("_id")).select(ref, F.when(F.col("_n") == 1, F.col("_id")).alias("commit"))


def _graph(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id and no (a number) of every commit; no, n, parent (a number, ``_BEYOND`` outside the history) and serial of every row. Stored."""
    names = stored(commits.select("id").distinct().withColumn("no", F.monotonically_increasing_id()))
    rows = commits.join(names, "id").select("no", "n", "parent", (F.col("serial").cast("long") if "serial" in commits.columns else F.lit(None).cast("long")).alias("serial"))
    parents = names.select(F.col("id").alias("parent"), F.col("no").alias("_p"))
    known = F.when(F.col("parent").isNotNull(), F.coalesce("_p", F.lit(_BEYOND).cast("long")))
    return names, stored(rows.join(parents, "parent", "left").select("no", "n", F.nullif(known, F.col("no")).alias("parent"), "serial"))


def _chained(names: DataFrame, graph: DataFrame) -> DataFrame:
    """no, chain, place, serial of every commit: a stored table."""
    heirs = graph.where(f"n = 0 AND parent <> {_BEYOND}").groupBy("parent").agg(F.min("no").alias("no")).select("no", F.col("parent").alias("top"))
    rows = names.select("no").join(heirs, "no", "left")
    starts = rows.where("top IS NULL").select(F.col("no").alias("top"), F.lit(True).alias("start"))
    rows = rows.join(starts, "top", "left")
    rows = stored(rows.select("no", F.coalesce("top", "no").alias("top"), F.when(F.col("top").isNull(), 0).otherwise(1).cast("long").alias("place"), (F.col("top").isNull() | F.col("start").isNotNull()).alias("done")))
    finished = [rows.where("done")]
    while not rows.where("NOT done").isEmpty():
        # The tops of rows that are not done are all different, so no key of this join is hot.
        ahead = reduce(DataFrame.unionByName, finished).unionByName(rows.where("NOT done"))
        ahead = ahead.select(F.col("no").alias("top"), F.col("top").alias("_top"), F.col("place").alias("_place"), F.col("done").alias("_done"))
        moved = rows.where("NOT done").join(ahead, "top").select("no", F.col("_top").alias("top"), (F.col("place") + F.col("_place")).alias("place"), F.col("_done").alias("done"))
        rows = stored(moved)
        finished.append(rows.where("done"))
    rows = reduce(DataFrame.unionByName, finished).select("no", F.col("top").alias("chain"), "place")
    return stored(rows.join(graph.groupBy("no").agg(F.min("serial").alias("serial")), "no"))


def chains(commits: DataFrame) -> DataFrame:
    """id, chain (a number), place (0 for its oldest commit) of every commit."""
    names, graph = _graph(commits)
    return names.join(_chained(names, graph), "no").select("id", "chain", "place")


def _edges(graph: DataFrame, places: DataFrame) -> tuple[DataFrame, bool]:
    """chain, place, to_chain, to_place and to_serial of edges between chains, stored; whether serials fall along every edge."""
    to = places.select(F.col("no").alias("parent"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"), F.col("serial").alias("to_serial"))
    every = graph.where("parent IS NOT NULL").select("no", "parent").join(places, "no").join(to, "parent", "left").withColumn("to_chain", F.coalesce("to_chain", F.lit(_BEYOND).cast("long")))
    wrong = (F.col("to_chain") != _BEYOND) & ~F.coalesce(F.col("to_serial") < F.col("serial"), F.lit(False))
    every = every.select("chain", "place", "to_chain", F.coalesce("to_place", F.lit(0)).cast("long").alias("to_place"), "to_serial", wrong.alias("wrong"))
    # Of edges within a chain one that rises is kept, to tell.
    odd = every.where("chain = to_chain AND wrong").limit(1)
    kept = stored(every.where("chain <> to_chain").unionByName(odd))
    return kept.where("chain <> to_chain").drop("wrong"), kept.where("wrong").isEmpty()


def _ending(edges: DataFrame) -> DataFrame:
    """chain, low: the first place of each chain from which the end of the known history is reached."""
    new = stored(edges.where(F.col("to_chain") == _BEYOND).groupBy("chain").agg(F.min("place").alias("low")))
    found = [new]
    while not new.isEmpty():
        to = new.select(F.col("chain").alias("to_chain"), F.col("low").alias("_low"))
        step = edges.join(to, "to_chain").where("to_place >= _low").groupBy("chain").agg(F.min("place").alias("low"))
        known = reduce(DataFrame.unionByName, found).groupBy("chain").agg(F.min("low").alias("_known"))
        new = stored(step.join(known, "chain", "left").where("_known IS NULL OR low < _known").select("chain", "low"))
        found.append(new)
    return reduce(DataFrame.unionByName, found).groupBy("chain").agg(F.min("low").alias("low"))


def _walked(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """``reach`` with all edges between chains in every task; they are few."""
    leave: dict[int, tuple[list, list]] = {}
    for chain, place, *to_edge in sorted(map(tuple, edges.select("chain", "place", "to_chain", "to_place", F.coalesce("to_serial", F.lit(0))).collect())):
        at, to = leave.setdefault(chain, ([], []))
        at.append(place)
        to.append(to_edge)
    shared = sources.sparkSession.sparkContext.broadcast(leave)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for source, chain, place, least in zip(*(c.to_pylist() for c in batch.columns)):
                best, taken, todo = {chain: place}, {}, [chain]
                while todo:
                    here = todo.pop()
                    at, to = shared.value.get(here, ((), ()))
                    end = bisect_right(at, best[here])
                    for there, height, serial in to[taken.get(here, 0) : end]:
                        if height > best.get(there, -1) and (least is None or serial >= least):
                            best[there] = height
                            todo.append(there)
                    taken[here] = max(end, taken.get(here, 0))
                for column, values in zip(out, ([source] * len(best), best.keys(), best.values())):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["source", "chain", "place"])

    return stored(sources.select("source", "chain", "place", "least").mapInArrow(walk, "source long, chain long, place long"))


def reach(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """source, chain, place: the farthest place of every chain that each of sources (source, chain, place, least) reaches, itself included.

    Commits with a serial below ``least`` are not looked at; null: all are.
    """
    edges = edges.where(F.col("to_chain") != _BEYOND)
    if edges.count() <= FEW_EDGES:
        return _walked(sources, edges)
    new = stored(sources.select("source", "chain", "place", F.lit(-1).cast("long").alias("below"), "least"))
    found = [new.select("source", "chain", "place")]
    while not new.isEmpty():
        # Edges at or below ``below`` were taken when the source reached so far.
        step = new.withColumnRenamed("place", "_to").join(edges, "chain").where("place <= _to AND place > below AND (least IS NULL OR to_serial >= least)")
        step = step.groupBy("source", "to_chain").agg(F.max("to_place").alias("place"), F.first("least").alias("least")).withColumnRenamed("to_chain", "chain")
        known = reduce(DataFrame.unionByName, found).groupBy("source", "chain").agg(F.max("place").alias("below"))
        new = stored(step.join(known, ["source", "chain"], "left").withColumn("below", F.coalesce("below", F.lit(-1).cast("long"))).where("place > below").select("source", "chain", "place", "below", "least"))
        found.append(new.select("source", "chain", "place"))
    return stored(reduce(DataFrame.unionByName, found).groupBy("source", "chain").agg(F.max("place").alias("place")))


def ancestry(pairs: DataFrame, commits: DataFrame) -> DataFrame:
    """Distinct (ancestor, descendant) with ``is_ancestor``; null if either is unknown, or undecided as the known history ends.

    A commit is its own ancestor. Commits of one chain are decided by their places. With
    serials that fall along every edge, only what is not older than the oldest ancestor
    asked for is walked; otherwise all that a descendant reaches.
    """
    names, graph = _graph(commits)
    places = _chained(names, graph)
    edges, sound = _edges(graph, places)
    pairs = stored(pairs.select("ancestor", "descendant").distinct())
    asked = pairs.select(F.col("ancestor").alias("id")).unionByName(pairs.select(F.col("descendant").alias("id"))).distinct()
    at = stored(asked.join(names, "id").join(places, "no").join(_ending(edges), "chain", "left").select("id", F.struct("no", "chain", "place", "serial", (F.col("place") >= F.col("low")).alias("ends")).alias("at")))
    side = lambda c, as_: at.select(F.col("id").alias(c), F.col("at").alias(as_))
    rows = stored(pairs.join(side("ancestor", "a"), "ancestor", "left").join(side("descendant", "d"), "descendant", "left"))
    one = F.col("a.chain") == F.col("d.chain")
    open_ = rows.where("a IS NOT NULL AND d IS NOT NULL").where(~one)
    if sound:
        open_ = open_.where("a.serial < d.serial")
    least = F.min("a.serial") if sound else F.lit(None).cast("long")
    sources = stored(open_.groupBy(F.col("d.no").alias("source"), F.col("d.chain").alias("chain"), F.col("d.place").alias("place")).agg(least.alias("least")))
    reached = reach(sources, edges).select(F.col("source").alias("_s"), F.col("chain").alias("_c"), F.col("place").alias("_place"))
    found = rows.join(reached, (F.col("d.no") == F.col("_s")) & (F.col("a.chain") == F.col("_c")), "left")
    place = F.when(one, F.col("d.place")).otherwise(F.col("_place"))
    answer = F.when(F.col("a").isNull() | F.col("d").isNull(), F.lit(None)).when(place >= F.col("a.place"), True).when(~F.coalesce("d.ends", F.lit(False)), False)
    return found.select("ancestor", "descendant", answer.alias("is_ancestor"))


def last_touch(touches: DataFrame) -> DataFrame:
    """path and its last commit, of touches (path, commit, at); the larger id of commits at one time."""
    return touches.groupBy("path").agg(F.max(F.struct("at", "commit"))["commit"].alias("last_touch"))


def freshness_of(notes: DataFrame, commits: DataFrame) -> DataFrame:
    """path and verdict (current, stale, unknown) of notes (path, export_commit, last_touch), named by id or prefix."""
    named = stored(notes.select(F.col("export_commit").alias("ref")).unionByName(notes.select(F.col("last_touch").alias("ref"))).where("ref IS NOT NULL").distinct())
    ids = stored(resolve(named, commits))
    rows = notes.select("path", "export_commit", "last_touch")
    for c, as_ in (("export_commit", "_e"), ("last_touch", "_t")):
        rows = rows.join(ids.select(F.col("ref").alias(c), F.col("commit").alias(as_)), c, "left")
    rows = stored(rows.select("path", "_e", "_t"))
    apart = rows.where("_e <> _t")
    pair = lambda a, b: apart.select(F.col(a).alias("ancestor"), F.col(b).alias("descendant"))
    known = ancestry(pair("_e", "_t").unionByName(pair("_t", "_e")), commits)
    answer = lambda a, b, name: known.select(F.col("ancestor").alias(a), F.col("descendant").alias(b), F.col("is_ancestor").alias(name))
    rows = rows.join(answer("_e", "_t", "_export_first"), ["_e", "_t"], "left").join(answer("_t", "_e", "_note_first"), ["_t", "_e"], "left")
    return rows.select("path", freshness(F.col("_e"), F.col("_t"), F.col("_export_first"), F.col("_note_first")).alias("verdict"))
