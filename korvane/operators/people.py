"""Questions about people and organisations as functions of tables.

orgs: id, parent_id, name, slug, type, active. people: id, name. roles: person, org, category, title. metrics: person,
field, value. areas: person, area.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korvane.operators.lineage import cut
from korvane.operators.order import ranks

ORG_TYPES = ("root", "college", "department", "office", "club")


def resolve_org(orgs: DataFrame, asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, org of asked names (id, name): the active organisation of that name or slug, else that of the alias (alias, slug); null for none."""
    q = asked.select("id", F.lower(F.trim("name")).alias("q"))
    live = orgs.where("active").select(F.col("id").alias("org"), F.lower("name").alias("n"), F.lower("slug").alias("s"))
    own = q.join(live, (q["q"] == live["n"]), "inner").select(q["id"], "org", F.lit(0).alias("tier"))
    slug = q.join(live, q["q"] == live["s"], "inner").select(q["id"], "org", F.lit(0).alias("tier"))
    also = q.join(aliases.select(F.lower("alias").alias("q"), F.lower("slug").alias("s")), "q").join(live, "s").select("id", "org", F.lit(1).alias("tier"))
    w = Window.partitionBy("id").orderBy("tier", "org")
    found = own.unionByName(slug).unionByName(also).withColumn("r", F.row_number().over(w)).where("r = 1")
    return q.select("id").join(found.select("id", "org"), "id", "left")


def descendants(orgs: DataFrame) -> DataFrame:
    """ancestor, id, depth: each organisation and all active ones under it, however deep; of a circle each is reached once."""
    live = orgs.where("active").select(F.col("id").alias("child"), F.col("parent_id").alias("up"))
    level = out = orgs.select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("depth"))
    depth = 0
    while True:  # a round a level of the deepest tree
        depth += 1
        below = level.join(live, level["id"] == live["up"]).select("ancestor", F.col("child").alias("id"), F.lit(depth).alias("depth")).distinct()
        level = cut(below.join(out.select("ancestor", "id"), ["ancestor", "id"], "left_anti"))
        if not level.limit(1).count():
            return out
        out = out.unionByName(level)


def orgs_by_type(orgs: DataFrame, kind: str, parent: int | None = None) -> DataFrame:
    """id, name of the active organisations of a type, under a parent if one is given; an unknown type has none."""
    held = orgs.where(F.col("active") & (F.col("type") == kind) & F.lit(kind in ORG_TYPES))
    return (held if parent is None else held.where(F.col("parent_id") == parent)).select("id", "name").orderBy("name", "id")


def people_in_org(people: DataFrame, roles: DataFrame, orgs: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """org, person, name, title: the people of each organisation and of those under it, once each, by their least title."""
    held = roles if categories is None else roles.where(F.col("category").isin(*categories))
    reach = descendants(orgs).select(F.col("ancestor"), F.col("id").alias("org"))
    found = held.join(reach, "org").groupBy(F.col("ancestor").alias("org"), "person").agg(F.min("title").alias("title"))
    return found.join(people.select(F.col("id").alias("person"), "name"), "person").select("org", "person", "name", "title")


def top_by_metric(people: DataFrame, roles: DataFrame, orgs: DataFrame, metrics: DataFrame, field: str) -> DataFrame:
    """org, person, value, place: standard competition ranks by a metric among the people of each organisation's subtree."""
    value = metrics.where(F.col("field") == field).groupBy("person").agg(F.max("value").alias("value"))
    return ranks(people_in_org(people, roles, orgs).join(value, "person").select("org", "person", "value"), "value", "org")


def metric_coverage(people: DataFrame, roles: DataFrame, orgs: DataFrame, metrics: DataFrame, field: str) -> DataFrame:
    """org, with_metric, total: how many of the people of a subtree have a metric."""
    value = metrics.where((F.col("field") == field) & F.col("value").isNotNull()).select("person").distinct().withColumn("has", F.lit(1))
    held = people_in_org(people, roles, orgs).join(value, "person", "left")
    return held.groupBy("org").agg(F.count("has").alias("with_metric"), F.count("*").alias("total"))


def area_counts(areas: DataFrame, roles: DataFrame, orgs: DataFrame) -> DataFrame:
    """org, area, people: distinct people of each area, spelling aside, in each organisation's subtree; the commonest spelling names it."""
    reach = descendants(orgs).select(F.col("ancestor"), F.col("id").alias("org"))
    mine = roles.select("person", "org").distinct().join(reach, "org").select(F.col("ancestor").alias("org"), "person").distinct()
    tagged = areas.select("person", F.trim("area").alias("area")).where("area <> ''").withColumn("folded", F.lower("area"))
    spelled = tagged.groupBy("folded", "area").agg(F.count("*").alias("n"))
    w = Window.partitionBy("folded").orderBy(F.desc("n"), "area")
    shown = spelled.withColumn("r", F.row_number().over(w)).where("r = 1").select("folded", "area")
    pairs = tagged.select("person", "folded").distinct().join(mine, "person")
    return pairs.groupBy("org", "folded").agg(F.countDistinct("person").alias("people")).join(shown, "folded").select("org", "area", "people")


def people_by_area(areas: DataFrame, asked: DataFrame) -> DataFrame:
    """id, person, hit: people whose areas hold an asked area (id, area) or one of its expansions (null ``exact`` counts as expansion), word by word; an exact hit outranks an expanded one."""
    padded = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))
    words = lambda c: F.filter(F.split(F.trim(c), " "), lambda x: x != "")
    q = asked.select("id", padded(F.col("area")).alias("q"), F.coalesce("exact", F.lit(False)).alias("exact")).where("q <> '  '")
    held = areas.select("person", padded(F.col("area")).alias("a")).distinct()
    # meet by the first word of what is asked, then compare whole phrases
    first = q.withColumn("w", F.element_at(words(F.col("q")), 1))
    pairs = held.withColumn("w", F.explode(F.array_distinct(words(F.col("a"))))).join(first, "w").where(F.contains("a", F.col("q")))
    return pairs.groupBy("id", "person").agg(F.when(F.max("exact"), "exact").otherwise("expanded").alias("hit"))
