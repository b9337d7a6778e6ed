"""Contigs in order, by the reads that run over several of them.

A read runs over a contig if ``least`` of its minimizers at least are the contig's unique ones; most of them say on which strand. The contigs of a read, in the order
in which it meets them, make pairs of neighbours. Ends name both sides of a contig: 2 * contig is its head, 2 * contig + 1 its tail. A pair joins the end by which the read leaves the
one to the end by which it enters the other, which is the same read from either strand. Pairs of at least ``support`` reads are edges, with the mean of the gaps that
the reads leave (rounded down; negative where contigs overlap).

An edge is a join if it has the most reads of all edges at both of its ends (of equals: the one to the least end). Then every end has one join at most, and contigs form chains, and
rings, each of which is opened at its join of the least end. Chains are numbered by pointers that double: a state is an end by which a contig is entered; it points to the
next one entered, then to the second next, and so on, in rounds that are written to the shared folder. No chain is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longpath.sources.files import stored


def edges(met: DataFrame, lengths: DataFrame, k: int, least: int = 1, support: int = 1) -> DataFrame:
    """low_end, high_end, reads and gap of each edge, from meetings (see ``minimizers``) and lengths (contig, length)."""
    hit = F.struct("read_place", "contig_place")
    runs = met.groupBy("read", "contig").agg(F.count("*").alias("n"), F.sum(F.col("same").cast("int")).alias("same"), F.min(hit).alias("first"), F.max(hit).alias("last")).where(F.col("n") >= least)
    runs = runs.join(lengths.select("contig", "length"), "contig").withColumn("turned", F.col("same") * 2 < F.col("n"))
    from_tail = lambda place: F.col("length") - k - F.col(place)
    before = F.when(F.col("turned"), from_tail("first.contig_place")).otherwise(F.col("first.contig_place"))
    behind = F.when(F.col("turned"), F.col("last.contig_place")).otherwise(from_tail("last.contig_place"))
    turned = F.col("turned").cast("int")
    runs = runs.select(
        "read", "contig", F.col("first.read_place").alias("at"), (F.col("first.read_place") - before).alias("start"), (F.col("last.read_place") + k + behind).alias("stop"),
        (2 * F.col("contig") + turned).alias("entered"), (2 * F.col("contig") + 1 - turned).alias("left"),
    )
    order = Window.partitionBy("read").orderBy("at", "contig")
    pairs = runs.select("left", F.lead("entered").over(order).alias("entered"), (F.lead("start").over(order) - F.col("stop")).alias("gap")).where("entered is not null")
    joined = pairs.groupBy(F.least("left", "entered").alias("low_end"), F.greatest("left", "entered").alias("high_end")).agg(F.count("*").alias("reads"), F.sum("gap").alias("gap"))
    return joined.where(F.col("reads") >= support).select("low_end", "high_end", "reads", F.floor(F.col("gap") / F.col("reads")).alias("gap"))


def joins(found: DataFrame) -> DataFrame:
    """The edges that are the best of both of their ends."""
    both = found.select(F.col("low_end").alias("e"), F.col("high_end").alias("other"), "reads").unionByName(found.select(F.col("high_end").alias("e"), F.col("low_end").alias("other"), "reads"))
    best = both.groupBy("e").agg(F.min(F.struct(-F.col("reads"), "other")).alias("b")).select("e", F.col("b.other").alias("other"))
    low, high = best.toDF("low_end", "high_end"), best.toDF("high_end", "low_end")
    return found.join(low, ["low_end", "high_end"]).join(high, ["low_end", "high_end"])


def _walked(states: DataFrame) -> DataFrame:
    """state, last, steps and least of states (state, next, least): the last state reached, in how many steps, and the least of the joins passed; next is null where a walk ended."""
    rounds = max(states.count(), 1).bit_length()
    now = stored(states.select("state", "next", F.col("state").alias("last"), F.lit(0).cast("long").alias("steps"), "least"), "chains")
    now = now.withColumn("last", F.coalesce("next", "state")).withColumn("steps", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long"))
    for _ in range(rounds):
        far = now.select(F.col("state").alias("next"), F.col("next").alias("n"), F.col("last").alias("l"), F.col("steps").alias("s"), F.col("least").alias("m"))
        now = now.join(far, "next", "left").select("state", F.col("n").alias("next"), F.coalesce("l", "last").alias("last"), (F.col("steps") + F.coalesce("s", F.lit(0))).alias("steps"), F.least("least", F.coalesce("m", "least")).alias("least"))
        now = stored(now, "chains")
        if now.where("next is not null").isEmpty():
            break
    return now


def _states(contigs: DataFrame, joined: DataFrame) -> DataFrame:
    """Both states of each contig, the next, and the least end of the join passed on the way."""
    at = joined.select(F.col("low_end").alias("left"), F.col("high_end").alias("next"), F.col("low_end").alias("least")).unionByName(joined.select(F.col("high_end").alias("left"), F.col("low_end").alias("next"), F.col("low_end").alias("least")))
    states = contigs.select(F.explode(F.array(2 * F.col("contig"), 2 * F.col("contig") + 1)).alias("state")).withColumn("left", F.col("state").bitwiseXOR(F.lit(1).cast("long")))
    return states.join(at, "left", "left").select("state", "next", "least")


def chains(contigs: DataFrame, joined: DataFrame) -> DataFrame:
    """chain (its least outer end), place in it (from 0), contig and turned for each of contigs (contig: distinct numbers); one without joins is a chain by itself."""
    contigs = contigs.select(F.col("contig").cast("long").alias("contig"))
    walked = _walked(_states(contigs, joined))
    rings = walked.where("next is not null").select(F.col("least").alias("low_end")).distinct()
    if not rings.isEmpty():
        walked = _walked(_states(contigs, joined.join(rings, "low_end", "left_anti")))
    # a walk that enters contig by its head (state 2 * contig) leads to the outer end behind the tail; from that end on, contig is turned
    ends = walked.select(F.floor(F.col("state") / 2).alias("contig"), F.struct(F.col("last").bitwiseXOR(F.lit(1).cast("long")).alias("chain"), F.col("steps").alias("place"), (F.col("state") % 2 == 0).alias("turned")).alias("w"))
    return ends.groupBy("contig").agg(F.min("w").alias("w")).select("w.chain", "w.place", "contig", "w.turned")
