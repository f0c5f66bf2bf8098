"""Duplicated blocks: maximal runs of equal lines at two places, grouped by their text, weighted and ranked.

The claim behind the plan: expanding an equal pair of lines up and down gives the maximal run on its diagonal, so the
blocks are exactly the runs of equal pairs that hold a pair of comparison lines. Which places have such a run needs
no pairs (:mod:`.repeats` counts instead), so the report's work follows the lines and the places found; how many runs
there are of each length (``run_lengths``) follows from the same counts. ``seed_pairs`` and ``runs`` are the pairs
themselves, for those who ask for them: equal pairs from a self join on the line's text, runs from gaps and islands
along diagonals. A line with n places has n(n-1)/2 pairs, which is the size of that answer; hot lines are salted by the
place of one side, so that many tasks make them.

Keys of texts have 128 bits. Lines are normalized and classified once and staged; the later steps read numbers from
there, and texts only for the blocks themselves.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage, unstage
from . import repeats
from .ranking import with_rank

#: Places of one line that a salt of the self join holds, about.
PLACES_PER_SALT = 256

_SPOT = "fa", "fb", "d"


def _keyed(lines: DataFrame, seed: int) -> DataFrame:
    return lines.withColumns({"f": F.xxhash64(F.lit(seed), "path_key"), "t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})


def numbered_files(lines: DataFrame, *unread: str) -> DataFrame:
    """Staged lines with ``f``, a number of the file (their order does not matter), and ``t1, t2``, the key of the text.

    Two files never have one number: paths are hashed with another seed until their numbers differ. Columns that nobody
    reads later are not staged.
    """
    if "t1" in lines.columns:
        return lines
    staged, seed = stage(_keyed(lines, 0).drop(*unread), "lines"), 0
    while not staged.groupBy("f").agg(F.min("path_key").alias("low"), F.max("path_key").alias("high")).where("low <> high").isEmpty():
        seed += 1
        staged = stage(staged.withColumn("f", F.xxhash64(F.lit(seed), "path_key")), "lines")
    return staged


def seed_pairs(lines: DataFrame) -> DataFrame:
    """(fa, ia, fb, ib) for each unordered pair of comparison lines with equal text."""
    own = numbered_files(lines).where("is_comparison").select("f", "idx", "t1", "t2")
    often = own.groupBy("t1", "t2").agg(F.count("*").alias("n")).where("n > 1")
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / PLACES_PER_SALT)).cast("int")
    held = own.join(often, ["t1", "t2"]).withColumn("salts", salts)
    left = held.select("t1", "t2", F.pmod(F.xxhash64("f", "idx"), F.col("salts")).cast("int").alias("salt"), F.col("f").alias("fa"), F.col("idx").alias("ia"))
    right = held.select("t1", "t2", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("f").alias("fb"), F.col("idx").alias("ib"))
    return left.join(right, ["t1", "t2", "salt"]).where("fa < fb or (fa = fb and ia < ib)").select("fa", "ia", "fb", "ib")


def _structural_pairs(lines: DataFrame, seeds: DataFrame) -> DataFrame:
    """Equal pairs on seeded diagonals with at least one line that seeds nothing: they only lengthen runs."""
    every = numbered_files(lines)
    diagonals = seeds.select("fa", "fb", (F.col("ib") - F.col("ia")).alias("d")).distinct()
    a = every.select(F.col("f").alias("fa"), F.col("idx").alias("ia"), F.col("t1").alias("a1"), F.col("t2").alias("a2"), F.col("is_comparison").alias("ca"))
    b = every.select(F.col("f").alias("fb"), F.col("idx").alias("ib"), F.col("t1").alias("b1"), F.col("t2").alias("b2"), F.col("is_comparison").alias("cb"))
    equal = "a1 = b1 and a2 = b2"
    # from the structural lines of the one side look up its partner on the diagonal, and the other way round
    down = diagonals.join(a.where("not ca"), "fa").withColumn("ib", F.col("ia") + F.col("d")).join(b, ["fb", "ib"]).where(equal)
    up = diagonals.join(b.where("not cb"), "fb").withColumn("ia", F.col("ib") - F.col("d")).join(a, ["fa", "ia"]).where(f"ca and {equal}")
    return down.select("fa", "ia", "fb", "ib").unionByName(up.select("fa", "ia", "fb", "ib"))


def runs(lines: DataFrame) -> DataFrame:
    """(fa, fb, d, first, last): maximal runs of equal lines on diagonals, with a seed and not overlapping themselves."""
    lines = numbered_files(lines)
    seeds = seed_pairs(lines)
    pairs = seeds.withColumn("seed", F.lit(1))
    if not lines.where("not is_comparison").isEmpty():
        pairs = pairs.unionByName(_structural_pairs(lines, seeds).withColumn("seed", F.lit(0)))
    spots = pairs.select("fa", "fb", (F.col("ib") - F.col("ia")).alias("d"), "ia", "seed")
    island = F.col("ia") - F.row_number().over(Window.partitionBy(*_SPOT).orderBy("ia"))
    found = spots.withColumn("island", island).groupBy(*_SPOT, "island").agg(F.min("ia").alias("first"), F.max("ia").alias("last"), F.max("seed").alias("seed"))
    # within one file a run that reaches into its partner is dropped whole
    return found.where("seed = 1 and not (fa = fb and last - first + 1 > d)").select(*_SPOT, "first", "last")


def run_lengths(lines: DataFrame) -> DataFrame:
    """(size, n): how many :func:`runs` of each length there are, counted without a row for each.

    Files of equal lines and extension are one class, with its number of members as weight; two stand for all.
    """
    given, lines = lines, numbered_files(lines, "text", "line_number")
    held = F.array_sort(F.collect_list(F.struct("idx", "t1", "t2")))
    same = F.struct("extension", "all")
    files = lines.groupBy("f").agg(F.first("extension").alias("extension"), held.alias("all")).select("f", F.xxhash64(same).alias("c1"), F.xxhash64(F.lit(1), same).alias("c2"))
    classes = stage(files.groupBy("c1", "c2").agg(F.min("f").alias("f"), F.max("f").alias("other"), F.count("*").alias("w")), "classes")
    two = classes.select(F.explode(F.array_distinct(F.array("f", "other"))).alias("f"))
    own = stage(lines.join(two, "f", "left_semi").select("f", "idx", "t1", "t2", "is_comparison"), "own")
    out = repeats.run_lengths(own, classes.select("f", "w"))
    unstage(*([] if lines is given else [lines]), classes, own)
    return out


class Found(NamedTuple):
    """What detection leaves: files with their lines, and the places of blocks by the key of their text."""

    files: DataFrame  # f, path_key, extension, all, c1, c2
    places: DataFrame  # k1, k2, path_key, start_line, end_line, line_count, character_count, f, first, last


def find(lines: DataFrame) -> Found:
    """All places of duplicated blocks, one row each; nothing is gathered by block.

    Files of equal lines and extension are one class: two of them stand for all (one pair within a file, one across
    copies), and what is found at a place of theirs holds at that place of every member. However many copies of a file
    there are, their pairs are not made.
    """
    lines = numbered_files(lines)
    held = F.array_sort(F.collect_list(F.struct("idx", "line_number", "text")))
    files = lines.groupBy("f").agg(F.first("path_key").alias("path_key"), F.first("extension").alias("extension"), held.alias("all"))
    same = F.struct("extension", "all.text")
    files = stage(files.withColumns({"c1": F.xxhash64(same), "c2": F.xxhash64(F.lit(1), same)}), "files")
    two = files.groupBy("c1", "c2").agg(F.min("f").alias("low"), F.max("f").alias("high")).select(F.explode(F.array_distinct(F.array("low", "high"))).alias("f"))
    found = repeats.places(lines.join(two, "f", "left_semi"))
    # members of a class have the same places
    of_class = found.join(files.select("f", "c1", "c2"), "f").select("c1", "c2", "first", "last").distinct()
    told = of_class.join(files, ["c1", "c2"]).withColumn("own", _cut()).withColumn("text", F.col("own.text"))
    places = told.select(
        F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "path_key",
        F.col("own")[0]["line_number"].alias("start_line"), F.element_at("own", -1)["line_number"].alias("end_line"),
        F.size("text").cast("long").alias("line_count"), F.aggregate("text", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("character_count"),
        "f", "first", "last",
    )
    return Found(files, stage(places, "places"))


def _cut():
    return F.slice("all", F.col("first") + 1, F.col("last") - F.col("first") + 1)


def summary(found: Found) -> DataFrame:
    """(k1, k2, lines, n_places, line_count, character_count, weight, first_path, first_line) for each block."""
    one = F.min(F.struct("path_key", "start_line", "end_line", "f", "first", "last")).alias("one")
    counted = found.places.groupBy("k1", "k2").agg(F.count("*").alias("n_places"), F.max("line_count").alias("line_count"), F.max("character_count").alias("character_count"), one)
    # whatever pair made a place, its partner is another one: a block has two at least
    heads = counted.select("k1", "k2", "n_places", "line_count", "character_count", F.col("one.path_key").alias("first_path"), F.col("one.start_line").alias("first_line"), "one.f", "one.first", "one.last")
    full = heads.join(found.files.select("f", "all"), "f").withColumn("lines", F.col("all.text"))
    cut = F.slice("lines", F.col("first") + 1, F.col("last") - F.col("first") + 1)
    weight = (F.col("n_places") - 1) * F.col("line_count") * F.col("character_count")
    return full.select("k1", "k2", cut.alias("lines"), "n_places", "line_count", "character_count", weight.alias("weight"), "first_path", "first_line")


def blocks(lines: DataFrame) -> DataFrame:
    """(block_text, path_key, start_line, end_line, n_places, line_count, character_count, weight): a row for each place."""
    found = find(lines)
    told = summary(found).select("k1", "k2", F.array_join("lines", "\n").alias("block_text"), "n_places", "line_count", "character_count", "weight")
    return found.places.select("k1", "k2", "path_key", "start_line", "end_line").join(told, ["k1", "k2"]).drop("k1", "k2")


#: The total order of blocks, and whether it descends: texts differ, so no two are equal.
ORDER = {"weight": True, "line_count": True, "character_count": True, "first_path": False, "first_line": False, "block_text": False}


def sortable(found: DataFrame) -> DataFrame:
    """Summarised blocks with all columns of the order."""
    return found.withColumn("block_text", F.array_join("lines", "\n"))


def order() -> list:
    return [F.desc(c) if down else F.asc(c) for c, down in ORDER.items()]


def ranked(found: DataFrame) -> DataFrame:
    """Blocks in report order: a global sort by ranges."""
    return sortable(found).orderBy(*order())


def numbered(found: DataFrame) -> DataFrame:
    """Blocks with their ``rank`` in the report."""
    return with_rank(sortable(found), *order())
