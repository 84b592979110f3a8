"""Questions to skills: an ordered table of rules over cues and resolved candidates; the first rule that holds decides.

A rule is a condition and arguments in SQL over the columns of a question: its cues (one boolean for each pattern of
:data:`CUES`), and what was resolved in it (people, organisation, area, metric, link, role). Catalyst sees one expression for all
rules, a question is one row, and the name of the rule that decided is in the result. Cues and rules are parameters.

Defined results: null, empty and unmatched questions have no route (null rule and skill), which leaves them to retrieval;
a question that names several people of one name goes to ``person_disambig`` with the skill it was meant for; a
question's candidates come once, repeated rows are routed each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvane.functions import phrases
from korvane.operators.lineage import cut

#: Words that show what a question is about; whole words, any case.
CUES: dict[str, str] = {
    "paper": "papers?|publications?|articles?|preprints?",
    "peak": "best|peak|top|most",
    "year_word": "years?",
    "in_year": "in (19|20)[0-9]{2}",
    "cited": "cited|citations?",
    "since": "since",
    "growth": "grow|grown|growing|growth|trend|trending",
    "lists_area": "lists?|listed|listing",
    "how_many": "how many|number of",
    "areas": "(research )?(areas|topics|fields)",
    "rank": "most|top|highest|largest|leading|best|rank|ranking|common",
    "least": "least|lowest|fewest|worst|bottom",
    "faculty": "faculty|professors?|lecturers?|academic staff|instructors?",
    "people": "people|staff|members|employees|team",
    "who": "who|whose|whom",
    "list": "list|show|name|all|which",
    "officer": "officers?|e-?board|executive board|president|treasurer|secretary",
    "process": "how (do|can|to)|become|apply|elect|election|eligib[a-z]*|requirements?",
    "college_type": "colleges",
    "club_type": "clubs|societies|organi[sz]ations",
    "department_type": "departments|units|schools",
    "research": "research|researches|works? on|working on|stud(y|ies)",
    "about": "tell me about|about|info|information|profile|contact|e-?mail|phone|office|title",
}


@dataclass(frozen=True)
class Rule:
    name: str
    skill: str
    when: str
    args: str = "map()"


def _one(name: str, skill: str, when: str, args: str = "") -> list[Rule]:
    """A rule about one person, and its twin where the name stands for several."""
    extra = f", {args}" if args else ""
    return [
        Rule(name, skill, f"({when}) AND n_people = 1", f"map('entity_id', person{extra})"),
        Rule(f"{name}, several people", "person_disambig", f"({when}) AND n_people > 1", f"map('origin', '{skill}', 'candidates', n_people{extra})"),
    ]


_SCOPED = "'org_id', org"
_ROOTED = "'org_id', coalesce(org, root), 'org_defaulted', org IS NULL AND root IS NOT NULL"
_ABOUT_PEOPLE = "(faculty OR who OR people)"

#: The order is the meaning: what is narrower comes first.
RULES: list[Rule] = [
    *_one("papers", "papers_of_person", "paper", "'mode', CASE WHEN cited THEN 'cited' ELSE 'recent' END, 'n', top_n"),
    Rule("papers of an organisation", "papers_cross_unsupported", "paper AND org IS NOT NULL"),
    *_one("trend", "citation_trend_of_person", "(peak AND year_word) OR growth OR (in_year AND cited AND NOT since)", "'mode', CASE WHEN peak AND year_word THEN 'peak' WHEN growth THEN 'growth' ELSE 'year' END, 'year', asked_year"),
    Rule("who lists an area", "people_by_area_tag", "lists_area AND who AND area IS NOT NULL", f"map('area', area, {_SCOPED})"),
    Rule("how many in an area", "count_people_by_research_area", "how_many AND area IS NOT NULL", f"map('area', area, {_SCOPED})"),
    *_one("a person's area", "does_person_research_area", "area IS NOT NULL", "'area', area"),
    Rule("people of an area", "people_by_research_area", "area IS NOT NULL", f"map('area', area, {_SCOPED})"),
    Rule("counts of areas", "area_counts", "org IS NOT NULL AND areas AND rank", f"map({_SCOPED})"),
    Rule("areas of an organisation", "areas_in_org", "org IS NOT NULL AND areas AND NOT faculty", f"map({_SCOPED})"),
    Rule("areas of its faculty", "faculty_areas_in_department", "org IS NOT NULL AND areas", f"map({_SCOPED})"),
    Rule("lowest metric", "metric_descending_unsupported", f"metric IS NOT NULL AND least AND {_ABOUT_PEOPLE}", f"map('metric', metric, 'n', top_n, {_ROOTED})"),
    Rule("highest metric", "top_people_by_metric", f"metric IS NOT NULL AND rank AND (org IS NOT NULL OR ({_ABOUT_PEOPLE} AND root IS NOT NULL)) AND n_people = 0", f"map('metric', metric, 'n', top_n, {_ROOTED})"),
    *_one("a person's metric", "metric_of_person", "metric IS NOT NULL", "'metric', metric"),
    *_one("a person's link", "link_of_person", "link IS NOT NULL", "'link', link"),
    Rule("officers", "officers_in_org", "officer AND org IS NOT NULL AND has_officers AND NOT process AND role IS NULL", f"map({_SCOPED})"),
    Rule("role in an organisation", "people_by_role", "role IS NOT NULL AND NOT process AND (who OR list OR org IS NOT NULL) AND n_people = 0", "map('role', role, 'org_id', coalesce(climbed, org))"),
    Rule("colleges", "orgs_by_type", "college_type AND list", "map('type', 'college', 'org_id', nullif(org, root))"),
    Rule("clubs", "orgs_by_type", "club_type AND list AND org IS NULL", "map('type', 'club')"),
    Rule("departments of an organisation", "org_departments", "department_type AND org IS NOT NULL AND has_children AND NOT faculty", f"map({_SCOPED})"),
    Rule("faculty of an organisation", "faculty_in_department", "org IS NOT NULL AND faculty", f"map({_SCOPED})"),
    Rule("people of an organisation", "people_in_org", "org IS NOT NULL AND (people OR who) AND NOT (org <=> root)", f"map({_SCOPED})"),
    Rule("people of a name", "people_by_name", "list AND NOT who AND n_people > 0", "map('name', person_name, 'n', n_people)"),
    *_one("a person's research", "research_of_person", "research"),
    *_one("a person", "entity_card", "who OR about OR n_words = name_words"),
    Rule("a bare role", "people_by_role", "role IS NOT NULL AND org IS NULL AND n_words = role_words AND NOT process", "map('role', role)"),
    Rule("bare officers", "ambiguous_officers", "officer AND org IS NULL AND n_words <= 2 AND NOT process"),
]

#: Columns of candidates and what stands for one that is not given.
CANDIDATES: dict[str, str] = {
    "person": "CAST(NULL AS BIGINT)", "person_name": "CAST(NULL AS STRING)", "n_people": "0L", "name_words": "-1L", "org": "CAST(NULL AS BIGINT)", "root": "CAST(NULL AS BIGINT)",
    "climbed": "CAST(NULL AS BIGINT)", "has_officers": "false", "has_children": "false", "area": "CAST(NULL AS STRING)", "metric": "CAST(NULL AS STRING)", "link": "CAST(NULL AS STRING)",
    "role": "CAST(NULL AS STRING)", "role_words": "-1L",
}


def _strings(args: str) -> str:
    """Arguments of one type: the values of a SQL ``map(k, v, ...)`` as text."""
    inner, depth, parts, at = args[4:-1], 0, [], 0
    for i, c in enumerate(inner + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(inner[at:i].strip())
            at = i + 1
    values = [p if j % 2 == 0 else f"CAST({p} AS STRING)" for j, p in enumerate(parts) if p]
    return f"map({', '.join(values)})" if values else "CAST(map() AS MAP<STRING, STRING>)"


def route(questions: DataFrame, rules: list[Rule] = RULES, cues: dict[str, str] = CUES) -> DataFrame:
    """id, rule, skill, args of questions (id, text and any of :data:`CANDIDATES`); args is a map of texts without null values."""
    have = set(questions.columns)
    text = F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[?!. ]+$", "")))
    given = [F.expr(f"coalesce({c}, {d})" if c in have else d).alias(c) for c, d in CANDIDATES.items()]
    rows = questions.select("id", text.alias("_t"), *given)
    rows = rows.select("*", *(F.rlike("_t", F.lit(f"(?<![a-z0-9])({p})(?![a-z0-9])")).alias(c) for c, p in cues.items()))
    top = F.regexp_extract("_t", "(?:top|first) ([0-9]{1,3})(?![0-9])", 1).try_cast("int")
    rows = rows.withColumn("top_n", top).withColumn("asked_year", F.regexp_extract("_t", "in ((?:19|20)[0-9]{2})(?![0-9])", 1).try_cast("int"))
    rows = rows.withColumn("n_words", F.size(F.regexp_extract_all("_t", F.lit("[^\\s]+"), F.lit(0))))
    picked = F.coalesce(*(F.when(F.expr(r.when), F.struct(F.lit(r.name).alias("rule"), F.lit(r.skill).alias("skill"), F.expr(_strings(r.args)).alias("args"))) for r in rules))
    told = rows.where("true").select("id", picked.alias("p"))
    return told.select("id", "p.rule", "p.skill", F.map_filter("p.args", lambda _, v: v.isNotNull()).alias("args"))


def _keyed(entries: DataFrame) -> DataFrame:
    """phrase_id, text, entry, n, label of entries (entry, text, label) by their lower-cased names; several of one name give the smallest."""
    names = entries.where(F.col("entry").isNotNull() & F.col("text").isNotNull()).groupBy(F.lower("text").alias("text")).agg(F.min("entry").alias("entry"), F.count_distinct("entry").alias("n"), F.min("label").alias("label"))
    return names.select(F.xxhash64("text").alias("phrase_id"), "text", "entry", "n", "label")


def resolved(questions: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """The questions (id, text) with a struct (entry, label, n, words) for each kind: the entry (entry, text, label) whose name they hold, the longest one.

    ``n`` counts the entries of that name, ``words`` the words of it. Several entries of one name give the smallest. Questions are told apart
    by id: rows of one id hold what any of them holds. Each distinct text is searched once, for all kinds from the same table of texts.
    """
    texts = cut(questions.select("text").where("text is not null").distinct().select(F.monotonically_increasing_id().alias("text_id"), "text"))
    found = []
    for kind, entries in kinds.items():
        keyed = _keyed(entries)
        best = phrases.longest(texts, keyed.select("phrase_id", "text")).join(keyed.drop("text"), "phrase_id")
        # of several matches of one id the one of most words counts, ties to the smaller phrase
        found.append(best.select("text_id", F.lit(kind).alias("kind"), F.struct("words", (-F.col("phrase_id")).alias("less"), "entry", "label", "n").alias("hit")))
    every = reduce(DataFrame.unionByName, found).groupBy("text_id").agg(*(F.max(F.when(F.col("kind") == k, F.col("hit"))).alias(k) for k in kinds))
    out = questions.join(every.join(texts, "text_id").drop("text_id"), "text", "left")
    own = Window.partitionBy("id")
    return out.select(*questions.columns, *(F.when(F.col("id").isNotNull(), F.max(k).over(own)).alias(k) for k in kinds))


def candidates(questions: DataFrame, people: DataFrame, orgs: DataFrame, root: int | None = None) -> DataFrame:
    """questions (id, text) with people (full names first, else surnames) and organisations resolved.

    people: id, name, surname; orgs: id, name and, if wanted, has_children.
    """
    c = F.col
    named = lambda df, text: df.select(c("id").alias("entry"), c(text).alias("text"), c(text).alias("label"))
    told = resolved(questions.select("id", "text"), {"_full": named(people, "name"), "_short": named(people, "surname"), "_org": named(orgs, "name")}).withColumn("org", c("_org.entry"))
    pick = lambda x: F.when(c("_full").isNotNull(), c(f"_full.{x}")).otherwise(c(f"_short.{x}"))
    extra: list[Column] = [pick("entry").alias("person"), pick("label").alias("person_name"), F.coalesce(pick("n"), F.lit(0)).alias("n_people"), pick("words").alias("name_words")]
    out = told.select("id", "text", *extra, "org", F.lit(root).cast("long").alias("root"))
    if "has_children" in orgs.columns:
        out = out.join(orgs.select(c("id").alias("org"), "has_children"), "org", "left")
    return out
