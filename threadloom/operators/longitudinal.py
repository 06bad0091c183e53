"""Projects over time: timelines, dormancy, connections, synthesis lists, and choices of members to refine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values. Sizes of lists and the gap after which a project counts as dormant.
LEAST_MEMBERS = 3
MOST_EVENTS = 12
DORMANT_DAYS = 75


def evenly_spaced(members: DataFrame, group: str, order: list[Column], most: int = MOST_EVENTS) -> DataFrame:
    """All members of a small group; of a larger one `most`, evenly spaced from the first to the last. Adds place, n."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    placed = members.withColumn("place", place).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    # The i-th of `most` sits at i * (n - 1) / (most - 1), halves to the even place.
    spots = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(float(most - 1))).cast("int"))
    return placed.where((F.col("n") <= most) | F.array_contains(spots, F.col("place")))


def project_members(profiles: DataFrame) -> DataFrame:
    """One row per profile and project."""
    return profiles.select("*", F.posexplode("projects").alias("project_pos", "project"))


def recurring(members: DataFrame, least: int = LEAST_MEMBERS) -> DataFrame:
    counts = members.groupBy("project").agg(F.count(F.lit(1)).alias("members"))
    return counts.where(F.col("members") >= least)


def timelines(members: DataFrame) -> DataFrame:
    """project, members, events (place, key, at): sampled events of recurring projects, undated last.

    members: project, key, at.
    """
    often = members.join(recurring(members), "project")
    chosen = evenly_spaced(often, "project", [F.col("at").asc_nulls_last(), F.col("key").asc()])
    event = F.struct("place", "key", "at")
    return chosen.groupBy("project", "members").agg(F.array_sort(F.collect_list(event)).alias("events"))


def current_state(members: DataFrame, value: str) -> DataFrame:
    """project, state: `value` of the last member in timeline order."""
    often = members.join(recurring(members), "project")
    last = F.max(F.struct(F.col("at").isNull().alias("u"), "at", "key", F.col(value).alias("v")))
    return often.groupBy("project").agg(last["v"].alias("state"))


def dormant(members: DataFrame, gap: str = f"{DORMANT_DAYS} days") -> DataFrame:
    """Projects with a gap of at least `gap` between consecutive dated members. members: project, at."""
    dated = members.where("at is not null")
    before = F.lag("at").over(Window.partitionBy("project").orderBy("at"))
    return dated.withColumn("before", before).groupBy("project").agg(F.bool_or(F.col("at") - F.col("before") >= F.expr(f"interval {gap}")).alias("dormant")).where("dormant").select("project")


def project_pairs(profiles: DataFrame) -> DataFrame:
    """left, right, first: adjacent different projects of a profile, with the first place that has them."""
    pairs = F.zip_with(F.slice("projects", F.lit(1), F.greatest(F.size("projects") - 1, F.lit(0))), F.slice("projects", F.lit(2), F.greatest(F.size("projects") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    rows = profiles.select("position", F.explode(pairs).alias("p")).select("position", "p.left", "p.right").where("left <> right")
    return rows.groupBy("left", "right").agg(F.min("position").alias("first"))


def first_seen(values: DataFrame, value: str, order: list[str], most: int) -> DataFrame:
    """The first `most` distinct values in order of first appearance: value, first."""
    first = values.groupBy(F.col(value).alias("value")).agg(F.min(F.struct(*order)).alias("first"))
    return first.orderBy("first").limit(most)


def most_common(values: DataFrame, value: str, order: list[str], most: int) -> DataFrame:
    """The `most` most frequent values; ties by first appearance: value, n."""
    counts = values.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(most).select("value", "n")


def category_profiles(membership: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per category, members in order of key: 8 conclusions, 8 open questions, 3 synopses, 5 keys."""
    rows = membership.join(profiles, F.col("key") == F.col("conversation_key"))

    def few(values: DataFrame, order: list[str], most: int, name: str) -> DataFrame:
        """The first values of each category, ranked before they are gathered."""
        rank = F.row_number().over(Window.partitionBy("category").orderBy(*order))
        chosen = values.withColumn("_r", rank).where(F.col("_r") <= most)
        return chosen.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "v"))), lambda x: x["v"]).alias(name))

    listed = lambda c: rows.select("category", "key", F.posexplode(c).alias("pos", "v"))
    out = few(rows.select("category", "key", F.col("key").alias("v")), ["key"], 5, "representative_keys")
    spoken = few(rows.select("category", "key", F.col("synopsis").alias("v")), ["key"], 3, "_synopses").select("category", F.filter("_synopses", lambda x: x != "").alias("characteristic_questions"))
    for part in (few(listed("decisions"), ["key", "pos"], 8, "major_conclusions"), few(listed("unresolved_questions"), ["key", "pos"], 8, "unresolved_threads"), spoken):
        out = out.join(part, "category", "left")
    none = F.array().cast("array<string>")
    return out.select("category", *(F.coalesce(c, none).alias(c) for c in ("major_conclusions", "unresolved_threads", "characteristic_questions", "representative_keys")))


def synthesis(profiles: DataFrame, members: DataFrame, titles: DataFrame) -> DataFrame:
    """section, rank, value: the archive's lists. profiles: by position; members: project, key, at; titles: key, title."""
    spark = profiles.sparkSession

    def ranked(df: DataFrame, section: str, value: Column, order: list) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(*order))  # at most a dozen rows
        return df.select(F.lit(section).alias("section"), rank.alias("rank"), value.alias("value"))

    decisions = F.when(F.size("decisions") > 0, F.col("decisions")).otherwise(F.array("synopsis"))
    reversals = profiles.where("temporal_role = 'reversal or reframing'").select("position", F.posexplode(decisions).alias("pos", "v"))
    questions = profiles.select("position", F.posexplode("unresolved_questions").alias("pos", "v"))
    themes = profiles.select("position", F.posexplode("recurring_themes").alias("pos", "v"))
    pairs = F.zip_with(F.slice("projects", F.lit(1), F.greatest(F.size("projects") - 1, F.lit(0))), F.slice("projects", F.lit(2), F.greatest(F.size("projects") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("l"), b.alias("r")))
    links = profiles.select("position", "primary_subject", F.posexplode(pairs).alias("pos", "p")).where("p.l <> p.r")
    sentence = F.concat(F.col("p.l"), F.lit(" connects with "), F.col("p.r"), F.lit(" through shared evidence in "), F.col("primary_subject"), F.lit("."))
    temporal = profiles.where("temporal_role is not null").join(titles, F.col("conversation_key") == F.col("key")).orderBy("position").limit(12)
    silent = dormant(members).orderBy("project").limit(12)
    often = profiles.select("position", F.posexplode("projects").alias("pos", "v"))
    often = often.join(recurring(members).select(F.col("project").alias("v")), "v", "left_semi")
    parts = [
        ranked(first_seen(links.withColumn("v", sentence), "v", ["position", "pos"], 12), "cross_domain_connections", F.col("value"), ["first"]),
        ranked(first_seen(often, "v", ["position", "pos"], 6), "recurring_projects", F.col("value"), ["first"]),
        ranked(most_common(themes, "v", ["position", "pos"], 6).withColumn("_o", F.monotonically_increasing_id()), "recurring_themes", F.col("value"), ["_o"]),
        ranked(temporal, "temporal_evolution", F.concat(F.col("title"), F.lit(": "), F.col("temporal_role"), F.lit(".")), ["position"]),
        ranked(first_seen(reversals, "v", ["position", "pos"], 12), "tensions_and_reversals", F.col("value"), ["first"]),
        ranked(silent, "dormant_threads", F.concat(F.col("project"), F.lit(" contains a dormant interval followed by renewed activity.")), ["project"]),
        ranked(first_seen(questions, "v", ["position", "pos"], 12), "opportunities", F.col("value"), ["first"]),
    ]
    out = spark.createDataFrame([], "section string, rank int, value string")
    for part in parts:
        out = out.unionByName(part)
    return out


def refinement(members: DataFrame, per_category: int, most: int) -> DataFrame:
    """category, rank, key: fairly chosen members. members: category, key, central (rank by degree, null: none), at.

    Within a category: the most central, the first, the last, the other central ones, then by date; each once. Across
    categories in turns, so a cap falls on all alike.
    """
    by = Window.partitionBy("category")
    when = [F.col("at").asc_nulls_last(), F.col("key").asc()]
    ranked = members.withColumn("early", F.row_number().over(by.orderBy(*when))).withColumn("late", F.count(F.lit(1)).over(by) - F.col("early") + 1)
    order = F.when(F.col("central") == 1, F.lit(0)).when(F.col("early") == 1, F.lit(1)).when(F.col("late") == 1, F.lit(2)).when(F.col("central").isNotNull(), F.lit(2) + F.col("central")).otherwise(F.lit(1000) + F.col("early"))
    chosen = ranked.withColumn("rank", F.row_number().over(by.orderBy(order))).where(F.col("rank") <= per_category)
    return chosen.orderBy("rank", "category").limit(most).select("category", "rank", "key")


def round_robin(ranked: DataFrame, group: str, rank: str, limit: int) -> DataFrame:
    """The first `limit` rows in turns over the groups."""
    return ranked.orderBy(rank, group).limit(limit)


def stratified(profiles: DataFrame, group: str, limit: int) -> DataFrame:
    """Per group: a third the most confident, then evenly spaced by date, then the latest, until `limit`."""
    by = Window.partitionBy(group)
    sure = max(1, limit // 3)
    rows = profiles.withColumn("_sure", F.row_number().over(by.orderBy(F.desc("confidence"), "key"))).withColumn("_place", F.row_number().over(by.orderBy(F.col("at").asc_nulls_last(), "key")) - 1).withColumn("_n", F.count(F.lit(1)).over(by))
    spots = F.transform(F.sequence(F.lit(0), F.lit(max(1, limit - 1))), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(max(1, limit - 1)))).cast("int"))
    order = F.when(F.col("_sure") <= sure, F.lit(0)).when(F.array_contains(spots, F.col("_place")), F.lit(1)).otherwise(F.lit(2))
    take = F.row_number().over(by.orderBy(order, F.when(order == 2, -F.col("_place")).otherwise(F.col("_place"))))
    return rows.withColumn("_take", take).where(F.col("_take") <= limit).drop("_sure", "_place", "_n", "_take")


def project_evidence(members: DataFrame, most: int = 24, each: int = 10) -> DataFrame:
    """The members that a remote model is shown of each large project, chosen as `stratified` does, with its `occurrences`.

    Large are the `most` projects with the most members, two at least; of equal ones those that come first by position.
    members: project, key, confidence, at, position.
    """
    often = members.groupBy("project").agg(F.count(F.lit(1)).alias("occurrences"), F.min("position").alias("_first"))
    often = often.orderBy(F.desc("occurrences"), "_first", "project").limit(most).where("occurrences >= 2").drop("_first")
    return stratified(members.join(often, "project"), "project", each)
