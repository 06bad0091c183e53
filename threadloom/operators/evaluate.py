"""Evaluation of inferred projects against known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values. Overlaps from which a project counts as matched, or as fragmented or merged.
MATCH = 0.2
FRAGMENT = 0.12


def jaccard(truth: DataFrame, inferred: DataFrame) -> DataFrame:
    """truth, inferred, overlap for pairs that share a member; each side: name, member.

    Pairs without a common member have overlap 0 and don't appear, so no cross join is needed.
    """
    t = truth.select(F.col("name").alias("truth"), "member").distinct()
    i = inferred.select(F.col("name").alias("inferred"), "member").distinct()
    sizes_t, sizes_i = t.groupBy("truth").agg(F.count(F.lit(1)).alias("nt")), i.groupBy("inferred").agg(F.count(F.lit(1)).alias("ni"))
    both = t.join(i, "member").groupBy("truth", "inferred").agg(F.count(F.lit(1)).alias("n"))
    return both.join(sizes_t, "truth").join(sizes_i, "inferred").select("truth", "inferred", (F.col("n") / (F.col("nt") + F.col("ni") - F.col("n"))).alias("overlap"))


def best_matches(overlaps: DataFrame) -> DataFrame:
    """truth, inferred, overlap, matched: the best inferred project of each known one; ties by name."""
    rank = F.row_number().over(Window.partitionBy("truth").orderBy(F.desc("overlap"), "inferred"))
    return overlaps.withColumn("_r", rank).where("_r = 1").select("truth", "inferred", "overlap", (F.col("overlap") >= MATCH).alias("matched"))


def verdicts(known: DataFrame, overlaps: DataFrame) -> DataFrame:
    """verdict, name: known projects that are missed or fragmented, and inferred ones that merge several.

    known: name. A known project is missed if no overlap reaches MATCH, and fragmented if several reach FRAGMENT. An inferred
    one merges the known projects whose best overlap, from FRAGMENT on, is with it; of equal overlaps the last name counts.
    """
    per = overlaps.groupBy("truth").agg(F.max("overlap").alias("top"), F.count_if(F.col("overlap") >= FRAGMENT).alias("near"), F.max_by("inferred", F.struct("overlap", "inferred")).alias("best"))
    met = known.select(F.col("name").alias("truth")).distinct().join(per, "truth", "left")
    missed = met.where(F.coalesce("top", F.lit(0.0)) < MATCH).select(F.lit("missed").alias("verdict"), F.col("truth").alias("name"))
    split = met.where("near > 1").select(F.lit("fragmented").alias("verdict"), F.col("truth").alias("name"))
    merged = per.where(F.col("top") >= FRAGMENT).groupBy(F.col("best").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("merged").alias("verdict"), "name")
    return missed.unionByName(split).unionByName(merged)


def fragments(overlaps: DataFrame) -> DataFrame:
    """One row: known projects spread over several inferred ones, and inferred ones that merge several."""
    found = verdicts(overlaps.select(F.col("truth").alias("name")), overlaps)
    return found.agg(F.count_if(F.col("verdict") == "fragmented").alias("fragmented"), F.count_if(F.col("verdict") == "merged").alias("merged"))


def key_differences(expected: DataFrame, given: DataFrame) -> DataFrame:
    """key, problem: keys that are missing, unexpected or repeated in `given`; none if both hold the same keys. Both: key."""
    counts = expected.select("key", F.lit(1).alias("e"), F.lit(0).alias("g")).unionByName(given.select("key", F.lit(0).alias("e"), F.lit(1).alias("g"))).groupBy("key").agg(F.sum("e").alias("e"), F.sum("g").alias("g"))
    problem = F.when(F.col("g") == 0, "missing").when(F.col("e") == 0, "unexpected").when(F.col("g") > 1, "repeated")
    return counts.select("key", problem.alias("problem")).where("problem is not null")


#: Fixed values. Words that say nothing about a category.
GENERIC = ("analysis", "design", "review", "conversation", "project", "result", "using")


def duplicate_names(categories: DataFrame) -> DataFrame:
    """Names that several leaf categories have, but for case and blanks at the ends. categories: name."""
    return categories.groupBy(F.trim(F.lower("name")).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")


def generic_terms(concepts: DataFrame) -> DataFrame:
    """GENERIC words that define at least two categories: term, n. concepts: category, term."""
    term = F.lower("term")
    return concepts.where(term.isin(*GENERIC)).groupBy(term.alias("term")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def missed_milestones(milestones: DataFrame, evidence: DataFrame) -> DataFrame:
    """Milestones that no timeline's evidence holds. Both: key."""
    return milestones.join(evidence.select("key").distinct(), "key", "left_anti").select("key")


def evidence_failures(evidence: DataFrame, known: DataFrame) -> DataFrame:
    """Evidence keys that no conversation has. evidence: item, key; known: key."""
    return evidence.join(known.select("key").distinct(), "key", "left_anti").groupBy("item").agg(F.count(F.lit(1)).alias("missing"))


def acceptance(figures: DataFrame) -> DataFrame:
    """condition, passed, for one row of figures.

    Fixed values: the least numbers and the failures allowed.
    """
    conditions = {
        "timelines": F.col("timelines") >= 4,
        "matched_projects": F.col("matched") >= 4,
        "temporal": F.col("temporal") >= 5,
        "open_loops": F.col("open_loops") >= 4,
        "dormant": F.col("dormant") >= 2,
        "reversals": F.col("reversals") >= 2,
        "connections": F.col("connections") >= 4,
        "duplicate_names": F.col("duplicate_names") == 0,
        "generic_names": F.col("generic_names") == 0,
        "evidence_failures": F.col("evidence_failures") == 0,
        "unsupported": F.col("unsupported") == 0,
    }
    rows = F.array(*(F.struct(F.lit(k).alias("condition"), v.alias("passed")) for k, v in conditions.items()))
    return figures.select(F.explode(rows).alias("c")).select("c.condition", "c.passed")
