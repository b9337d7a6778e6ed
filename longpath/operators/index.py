"""The index from k-mer to block as a table, and its probe: joins and aggregations only.

Key is (seed_ix, code), so codes of different patterns don't meet. An id numbers a block of consecutive tiles; 0 is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longpath.plans.config import PathConfig


def block_ids(reads: DataFrame, config: PathConfig) -> DataFrame:
    """read_ix, first_tile, last_tile and block_id when all reads are inserted whole, in order.

    The first id of a read is one more than the sum of len div (tile * block) + 1 over the reads before.
    """
    n = F.floor(F.length("seq") / config.tile).cast("int")
    sized = reads.select("read_ix", n.alias("n"), (F.floor(F.length("seq") / (config.tile * config.block)) + 1).cast("long").alias("ids"))
    start = running(sized)
    rows = start.where("n > 0").select("read_ix", "n", "before", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / config.block).cast("int"))).alias("k"))
    return rows.select(
        "read_ix", (F.col("k") * config.block).alias("first_tile"), F.least((F.col("k") + 1) * config.block, F.col("n")).cast("int").alias("stop"), (F.col("before") + 1 + F.col("k")).alias("block_id")
    ).select("read_ix", F.col("first_tile").cast("int").alias("first_tile"), (F.col("stop") - 1).alias("last_tile"), "block_id")


def running(sized: DataFrame, bounds: tuple[int, int] | None = None, parts: int = 256) -> DataFrame:
    """sized (read_ix, ids, ...) with before, the sum of ids over smaller read_ix: sums by range, then within ranges, of one exchange."""
    low, high = bounds or sized.agg(F.min("read_ix"), F.max("read_ix")).first()
    low, high = low or 0, high or 0
    ranged = sized.withColumn("part", F.floor((F.col("read_ix") - low) * parts / (high - low + 1)).cast("int")).repartition("part")
    sums = ranged.groupBy("part").agg(F.sum("ids").alias("s"))
    offset = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("offset"))  # at most parts rows
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("read_ix")) - F.col("ids")
    return ranged.withColumn("inside", inside).join(F.broadcast(offset), "part").withColumn("before", F.col("offset") + F.col("inside")).drop("part", "inside", "offset")


def occurrences(frames: DataFrame, blocks: DataFrame, config: PathConfig) -> DataFrame:
    """Distinct (seed_ix, code, block_id): a code counts once a block."""
    tile_block = frames.select("read_ix", "seed_ix", "code", (F.floor(F.col("tile_ix") / config.block) * config.block).cast("int").alias("first_tile"))
    return tile_block.join(blocks.select("read_ix", "first_tile", "block_id").hint("shuffle_hash"), ["read_ix", "first_tile"]).select("seed_ix", "code", "block_id").distinct()


def first_writer_index(occurrences: DataFrame) -> DataFrame:
    """seed_ix, code, id (the least block that has the code) and n (number of blocks that have it)."""
    return occurrences.groupBy("seed_ix", "code").agg(F.min("block_id").alias("id"), F.count("*").alias("n"))


def reservoir_index(occurrences: DataFrame, config: PathConfig) -> DataFrame:
    """seed_ix, code, id and n after all blocks were written in order: the c-th writer replaces the id iff
    ((code * patterns + seed_ix) xor block) mod c = c - 1 on the lower 32 bits; the last such writer stays.

    Writers are numbered per code, so only a code that a third of all blocks share would gather in one task; such a code's
    writers are ordered by the shuffle's external sort, not in memory.
    """
    order = F.row_number().over(Window.partitionBy("seed_ix", "code").orderBy("block_id"))
    rank = F.col("code") * config.patterns + F.col("seed_ix")
    ranked = occurrences.withColumn("c", order)
    wins = (rank.bitwiseXOR(F.col("block_id")).bitwiseAND(F.lit(0xFFFFFFFF)) % F.col("c")) == F.col("c") - 1
    return ranked.groupBy("seed_ix", "code").agg(F.max_by("block_id", F.when(wins, F.col("c"))).alias("id"), F.count("*").alias("n"))


def probe(frames: DataFrame, index: DataFrame) -> DataFrame:
    """frames with the id their code has in the index, 0 for none. Both grow with the reads, so neither is ever broadcast."""
    return frames.join(index.select("seed_ix", "code", "id").hint("merge"), ["seed_ix", "code"], "left").withColumn("id", F.coalesce("id", F.lit(0)).cast("long"))


def frame_membership(probed: DataFrame, config: PathConfig) -> DataFrame:
    """read_ix, tile_ix, frames, and how many of them have all patterns in the index."""
    per_frame = probed.groupBy("read_ix", "tile_ix", "frame_ix").agg(F.count_if(F.col("id") != 0).alias("hit"))
    return per_frame.groupBy("read_ix", "tile_ix").agg(F.count("*").alias("frames"), F.count_if(F.col("hit") == config.patterns).alias("full_frames"))


def tile_id_counts(probed: DataFrame) -> DataFrame:
    """read_ix, tile_ix, id and n: frames that hit an id, once a frame."""
    return probed.where("id <> 0").groupBy("read_ix", "tile_ix", "id").agg(F.count_distinct("frame_ix").alias("n"))


def tile_best(counts: DataFrame) -> DataFrame:
    """The id of most frames of each tile that hits any, the smaller id of equals."""
    best = F.max(F.struct("n", (-F.col("id")).alias("minus"))).alias("b")
    return counts.groupBy("read_ix", "tile_ix").agg(best).select("read_ix", "tile_ix", (-F.col("b.minus")).alias("id"), F.col("b.n").alias("n"))


def tile_candidates(counts: DataFrame, least: int = 2) -> DataFrame:
    """read_ix, tile_ix, place (by n descending, then id), id and n of ids with more than least frames."""
    order = F.row_number().over(Window.partitionBy("read_ix", "tile_ix").orderBy(F.desc("n"), "id"))
    return counts.where(F.col("n") > least).withColumn("place", order)


def tile_assigned(counts: DataFrame, config: PathConfig) -> DataFrame:
    """Tiles with candidates: whether the best has more than hits frames."""
    return tile_candidates(counts).where("place = 1").select("read_ix", "tile_ix", "id", "n", (F.col("n") > config.hits).alias("assigned"))


def probe_counters(probed: DataFrame, config: PathConfig) -> DataFrame:
    """One row: queries (frames), hits and misses (slots)."""
    return probed.agg((F.count("*") / config.patterns).cast("long").alias("queries"), F.count_if(F.col("id") != 0).alias("hits"), F.count_if(F.col("id") == 0).alias("misses"))


def id_frequencies(index: DataFrame) -> DataFrame:
    """id and n: slots that carry each id."""
    return index.groupBy("id").agg(F.count("*").alias("n"))


def lookup(probed: DataFrame, config: PathConfig, allowed_misses: int = 0) -> DataFrame:
    """Distinct ids of frames with at most so many patterns missing."""
    per_frame = probed.groupBy("read_ix", "tile_ix", "frame_ix").agg(F.count_if(F.col("id") == 0).alias("misses"), F.collect_set(F.when(F.col("id") != 0, F.col("id"))).alias("ids"))
    return per_frame.where(F.col("misses") <= allowed_misses).select("read_ix", "tile_ix", "frame_ix", "ids")


def set_if_empty(index: DataFrame, occurrences: DataFrame) -> DataFrame:
    """index (seed_ix, code, id) and, of occurrences (seed_ix, code, block_id), the least block of each code that is not in it."""
    key = ["seed_ix", "code"]
    new = occurrences.join(index.select(*key).hint("merge"), key, "left_anti").groupBy(*key).agg(F.min("block_id").alias("id"))
    return index.select(*key, "id").unionByName(new)


def solid(index: DataFrame, least: int = 2) -> DataFrame:
    """The codes of an index that at least so many blocks wrote: what an insertion of solid k-mers only would hold."""
    return index.where(F.col("n") >= least)


def saturated(index: DataFrame, most: int) -> DataFrame:
    """index with saturated: more than most blocks wrote the code, so its id stands for none of them."""
    return index.withColumn("saturated", F.col("n") > most)


def population(index: DataFrame, config: PathConfig, slots: int, most: int) -> DataFrame:
    """A row a pattern: codes, used slots of a bit vector of so many, their share, saturated codes, and ids that are not positive."""
    slot = F.pmod(F.col("code") * config.patterns + F.col("seed_ix"), F.lit(slots))
    return saturated(index, most).groupBy("seed_ix").agg(
        F.count("*").alias("codes"), F.count_distinct(slot).alias("used"), F.round(F.count_distinct(slot) / slots, 12).alias("occupancy"), F.count_if("saturated").alias("saturated"), F.count_if(F.col("id") <= 0).alias("abnormal")
    )
