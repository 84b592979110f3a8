"""Rules in order over texts and results: intents, questions to turn away, decisions, tiers of retrieval, kinds of pages and titles.

A rule is a :class:`Cue`; the first that holds decides, and all rules of a list become one expression, so that a text is one row
and nothing shuffles. Lists are parameters; the ones here are the library's own, but for those marked as fixed values.

Defined results: null and empty texts hold no cue (they fall to the last class of each operator); repeated rows are told
each; other columns pass through unchanged, and the result columns of an operator replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT = "(^|[^a-z0-9_])", "($|[^a-z0-9_])"


@dataclass(frozen=True)
class Cue:
    """``name`` holds where ``pattern`` and ``also`` are found and ``unless`` (with ``beside``, where given) is not, in texts of fewer than ``shorter`` characters.

    Patterns stand between word borders, or anywhere with ``inner``.
    """

    name: str
    pattern: str
    also: str = ""
    unless: str = ""
    beside: str = ""
    shorter: int = 0
    inner: bool = False
    sure: float = 1.0


def flat(text: Column) -> Column:
    """Lower-cased, white space collapsed and trimmed; empty for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \t\r\n\f]+", " "))


def has(text: Column, pattern: str) -> Column:
    """Whether the flat text holds the pattern between word borders."""
    return F.rlike(text, F.lit(f"{OPEN}(?:{pattern}){SHUT}"))


def _holds(text: Column, c: Cue) -> Column:
    found = (lambda p: F.rlike(text, F.lit(p))) if c.inner else (lambda p: has(text, p))
    told = found(c.pattern)
    if c.also:
        told = told & found(c.also)
    if c.unless:
        told = told & ~(found(c.unless) & found(c.beside) if c.beside else found(c.unless))
    return told & (F.length(text) < c.shorter) if c.shorter else told


def _found(text: Column, c: Cue) -> Column:
    return F.regexp_extract(text, f"({c.pattern})", 1) if c.inner else F.regexp_extract(text, f"{OPEN}({c.pattern}){SHUT}", 2)


def first(text: Column, cues: list[Cue]) -> Column:
    """A struct (name, found, sure) of the first cue that holds in a flat text: null where none does."""
    told = (F.struct(F.lit(c.name).alias("name"), _found(text, c).alias("found"), F.lit(c.sure).alias("sure")) for c in cues)
    return F.coalesce(*(F.when(_holds(text, c), t) for c, t in zip(cues, told)))


# ---- intents -------------------------------------------------------------------------------------------------------------

#: Words by which a message about food is about money or rules. Fixed values, parts of words.
FOOD_GUARD = ("cost", "budget", "limit", "spend", "reimburs", "per person", "per-person", "allowance", "maximum", "policy", "bylaw", "how much", "allowed", "cap ", "caps")
#: Words for food. Fixed values, parts of words; longer phrases that hold one of them add nothing and are left out.
FOOD = ("food", "snacks", "lunch", "dinner", "breakfast", "eat", "hungry", "pizza", "coffee", "drinks", "refreshments", "catering", "meal", "feeding")
FOOD_CATEGORIES = ("food", "social")

INTENTS: list[Cue] = [
    Cue("clear_history", "(clear|reset|forget|erase|delete|wipe) (my |our |the |this |all ){0,3}(history|chat|conversation|messages|memory|context)|start over|new chat"),
    Cue("free_mode", "(enable|enter|turn on|switch to|use|start) (the )?(free|general|open)([- ]chat)? mode"),
    Cue("topic_mode", "(enable|enter|turn on|switch to|back to|use|start) (the )?(topic|normal|default|campus)([- ]only)? mode|(disable|leave|turn off|exit|stop) (the )?(free|general|open) mode"),
    Cue("food", "|".join(FOOD), unless="|".join(FOOD_GUARD), inner=True),
    Cue("social", "fun|bored|party|parties|hang out|social|games?|movie night|make friends", shorter=40),
    Cue("greeting", "^(hi+|hello+|hey+|hiya|yo|greetings|howdy|sup|good (morning|afternoon|evening)|what ?s up)", shorter=30),
    Cue("farewell", "bye+|goodbye|bye bye|good ?night|see (you|ya)( later| soon| tomorrow)?|take care|farewell|later", shorter=40),
    Cue("thanks", "thanks?|thank you|thx|ty|appreciate (it|that)|much appreciated|cheers", shorter=50),
    Cue("help", "^help( me)?|what (can|do) you do|how do(es)? (you|this bot|this) work|what can i ask|commands?"),
    Cue("identity", "who (are|made|built|created) you|what are you|your name|are you (a |an )?(bot|human|robot|person|real)"),
]
#: Words that begin a question, among the first three of the message.
STARTERS = ("what", "when", "where", "who", "whom", "whose", "why", "which", "how", "is", "are", "was", "were", "do", "does", "did", "can", "could", "will", "would", "should", "has", "have", "tell", "list", "show", "explain")


def intents(rows: DataFrame, cues: list[Cue] = INTENTS, starters: tuple[str, ...] = STARTERS, text: str = "text") -> DataFrame:
    """``rows`` with intent and confidence: the first cue's, else question (0.9: a question mark at the end, or a starter among the first three words), else statement (0.5)."""
    rows, t = rows.withColumn("_t", flat(F.col(text))), F.col("_t")
    asks = t.endswith("?") | F.arrays_overlap(F.slice(F.split(t, " "), 1, 3), F.array(*(F.lit(s) for s in starters)))
    told = lambda name, sure: F.struct(F.lit(name).alias("name"), F.lit("").alias("found"), F.lit(sure).alias("sure"))
    rows = rows.withColumn("_c", F.coalesce(first(t, cues), F.when(asks, told("question", 0.9)).otherwise(told("statement", 0.5))))
    return rows.withColumn("intent", F.col("_c.name")).withColumn("confidence", F.col("_c.sure")).drop("_t", "_c")


# ---- what is turned away -------------------------------------------------------------------------------------------------

GUIDANCE = "^(how (do|can|should|to)( i| we| one)?|what (do|should) (i|we)|where (do|can|should) (i|we)|(who|whom) (do|should|can) (i|we)|(do|should|can|must|may) i (need|have|be|submit|use|apply|file))"
_RECORD = "balances?|holds?|refunds?|transcripts?|gpa|visa|i-?20|financial aid|assistantship|admission decision"
_NOW = "now|right now|today|tonight|currently|at the moment|this minute"


def deflections(others: list[str] = (), own: str = "", guidance: str = GUIDANCE) -> list[Cue]:
    """The families of questions that no stored text answers, in order. ``others``: names of other institutions (patterns), which are no reason where someone transfers to ``own``."""
    near = "([^ ]+ ){0,8}"
    return [
        Cue("personal", f"(what(s| is| are)?|how much is|when is|check|show( me)?|see|tell me) my {near}?({_RECORD})", unless=guidance),
        Cue("personal", "did i (get|pass|win|receive)|have i been (accepted|admitted|approved|charged)|(am|was) i (accepted|admitted|enrolled|registered|eligible)|do i (owe|have a hold)|my (student id|account number|password)", unless=guidance),
        Cue("personal", _RECORD, also=f"^(has|have|is|are|did|was|were) {near}?my", unless=guidance),
        Cue("task", f"(write|draft|compose|fill out|prepare|finish) {near}?(my|for me)|do (my|the) {near}?(homework|assignment|essay|paper)", unless=guidance),
        *([Cue("other_institution", "|".join(others), unless="transfer[a-z]*" if own else "", beside=own)] if others else []),
        Cue("live", "today|tonight|right now|currently|at the moment|this minute", also="my"),
        Cue("live", "open|available|free|cancell?ed|busy|wait time|the line|(seats?|spots?) left", also=_NOW, unless="events?|menu|dining"),
    ]


def deflected(rows: DataFrame, cues: list[Cue], text: str = "text") -> DataFrame:
    """``rows`` with deflect, family and cue: the words that turned a question away; null where it may be answered."""
    told = rows.withColumn("_t", flat(F.col(text))).withColumn("_c", first(F.col("_t"), cues))
    return told.withColumn("deflect", F.col("_c").isNotNull()).withColumn("family", F.col("_c.name")).withColumn("cue", F.col("_c.found")).drop("_t", "_c")


#: Questions for a figure: that a text is about them does not mean that it holds the figure.
FIGURES = "how (many|much|long)|what percentage|(pass|acceptance|graduation|retention) rate|(number|count|total|average|amount|rate|percentage) of|compared? to|how does [^\n]* compare"


def fact_shaped(text: Column) -> Column:
    return has(flat(text), FIGURES)


def decided(rows: DataFrame, band: float, cue: str = "cue", score: str = "score", label: str = "label", facts: str = "fact_shaped") -> DataFrame:
    """``rows`` with outcome, check and skip_fallback, from the first gate's cue, the relevance and the second gate's label.

    A cue deflects and skips the fallback. The second gate is asked (check) where the relevance is unknown (null or not a
    number), under ``band``, or the question is one for a figure; a label NOT_IN_CONTEXT then falls back, any other or a label
    not known yet answers. Null ``facts`` count as false.
    """
    turned, weak = F.col(cue).isNotNull() & (F.col(cue) != ""), F.col(score).isNull() | F.isnan(score) | (F.col(score) < band)
    check = ~turned & (weak | F.coalesce(F.col(facts), F.lit(False)))
    absent = F.coalesce(F.col(label) == "NOT_IN_CONTEXT", F.lit(False))
    told = F.struct(F.when(turned, "deflect").when(check & absent, "fallback").otherwise("answer").alias("outcome"), check.alias("check"), turned.alias("skip_fallback"))
    return rows.withColumn("_d", told).withColumn("outcome", F.col("_d.outcome")).withColumn("check", F.col("_d.check")).withColumn("skip_fallback", F.col("_d.skip_fallback")).drop("_d")


# ---- tiers of retrieval --------------------------------------------------------------------------------------------------

#: Relevance under which the primary tier missed, and which the office and deep tiers have to reach.
LIVE_FLOOR, OFFICE_FLOOR, DEEP_FLOOR = 0.15, 0.15, 0.30


def ladder(questions: DataFrame, results: DataFrame, floors: tuple[float, float, float] = (LIVE_FLOOR, OFFICE_FLOOR, DEEP_FLOOR), deep: bool = True, live: bool = True) -> DataFrame:
    """item_id, tier, miss, primary_relevance and relevance (of the tier) of questions (item_id) over results (item_id, doc_id, tier, place, score).

    A tier's relevance is the score of its first row that has one (an inserted profile has none; not-a-number is none). The
    primary tier missed where it is empty or its relevance is under the floor. Then the office tier is taken if it reaches its
    own floor; else the deep tier, if it reaches its floor and beats the primary one; else the live tier, if it has rows; else
    what the primary tier has, or ``none``. Questions of no results are kept; ones with a null id are left out. One exchange,
    by question, after partial aggregates.
    """
    asked = questions.select("item_id").where("item_id is not null").distinct()
    known = F.col("score").isNotNull() & ~F.isnan("score")
    at = F.struct("place", "doc_id", "score")
    tiers = ("primary", "office", "deep", "live")
    told = results.where("item_id is not null").groupBy("item_id").agg(
        *(F.min_by("score", F.when(known & (F.col("tier") == t), at)).alias(f"_{t}") for t in tiers),
        *(F.count(F.when(F.col("tier") == t, 1)).alias(f"_n_{t}") for t in tiers),
    )
    c = F.col
    n = lambda t: F.coalesce(c(f"_n_{t}"), F.lit(0))
    miss = (n("primary") == 0) | F.coalesce(c("_primary") < floors[0], F.lit(False))
    beats = (c("_deep") >= floors[2]) & (c("_primary").isNull() | (c("_deep") > c("_primary")))
    tier = F.when(~miss, "primary").when(c("_office") >= floors[1], "office")
    tier = tier.when(beats, "deep") if deep else tier
    tier = tier.when(n("live") > 0, "live") if live else tier
    out = asked.join(told, "item_id", "left").withColumn("tier", tier.when(n("primary") > 0, "primary").otherwise("none")).withColumn("miss", miss)
    relevance = F.coalesce(*(F.when(c("tier") == t, c(f"_{t}")) for t in tiers))
    return out.select("item_id", "tier", "miss", c("_primary").alias("primary_relevance"), relevance.alias("relevance"))


def served(results: DataFrame, choice: DataFrame) -> DataFrame:
    """The result rows of each question's chosen tier."""
    return results.join(choice.select("item_id", "tier"), ["item_id", "tier"])


# ---- rows, pages, titles -------------------------------------------------------------------------------------------------

#: Patterns of what tells a private person; the first group of a mail address is not needed.
MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+"


def screened(rows: DataFrame, least: int = 3, private: tuple[tuple[str, str], ...] = (("mail", MAIL),), text: str = "text") -> DataFrame:
    """``rows`` with refused: ``short`` for fewer than ``least`` words, else the name of the first private pattern found, else null (kept)."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.size(F.regexp_extract_all(t, F.lit("([^ \t\r\n\f]+)"), F.lit(1)))
    told = F.when(words < least, F.lit("short"))
    for name, pattern in private:
        told = told.when(F.rlike(t, F.lit(pattern)), F.lit(name))
    return rows.withColumn("refused", told)


def _parts(text: Column, parts: tuple[str, ...]) -> Column:
    told = F.lit(False)
    for p in parts:
        told = told | F.contains(text, F.lit(p))
    return told


def event_has_food(category: Column, name: Column, description: Column) -> Column:
    """An event by its category, or by a word for food in its name or description."""
    text = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit(""))))
    return F.coalesce(F.lower(category).isin(*FOOD_CATEGORIES), F.lit(False)) | _parts(text, FOOD)


def asks_for_food(text: Column) -> Column:
    """A question for food at events, not for money or rules about it."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return _parts(t, FOOD) & ~_parts(t, FOOD_GUARD)


#: Path pieces of money and immigration pages; terms of rules, whole (s may follow where marked) and as beginnings.
HIGH_TREES = ("/bursar", "/financialaid", "/student-accounts", "/global", "/international", "/oie", "/oge", "/sponsored")
HIGH_TERMS = ("visa", "visas", "i20", "i-20", "sevis", "cpt", "opt", "gre", "toefl", "ielts")
HIGH_STEMS = ("immigration", "work authoriz", "out of status", "maintain status", "maintaining status", "full time requirement", "full-time requirement", "forfeit", "dismiss", "terminat", "expel", "expuls", "probation", "penalt", "revok", "deport", "score requirement")


def stakes(url: Column, text: Column, volatile: Column) -> Column:
    """high for a page with a rule of consequence, or one of a money or immigration tree that held volatile values; else low."""
    rule = F.rlike(flat(text), F.lit(f"{OPEN}(?:(?:{'|'.join(HIGH_TERMS)}){SHUT}|{'|'.join(HIGH_STEMS)})"))
    tree = _parts(F.lower(F.coalesce(url, F.lit(""))), HIGH_TREES)
    return F.when(rule | (tree & F.coalesce(volatile, F.lit(False))), "high").otherwise("low")


#: Path segments that mark a kind of page.
NEWS, EVENTS = ("news", "newsroll", "announcement", "announcements"), ("event", "events")
PEOPLE = ("administration", "administration-and-faculty", "joint-faculty", "our-people", "people", "faculty", "staff", "leadership")


def segments(url: Column) -> Column:
    """Lower-cased segments of the path of an address, without empty ones."""
    path = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), "^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def page_kind(url: Column) -> Column:
    """people (a roster, or its numbered alias), news, event or policy, by whole segments of the path."""
    s = segments(url)
    any_of = lambda a, names: F.arrays_overlap(a, F.array(*(F.lit(n) for n in names)))
    plain = F.transform(s, lambda x: F.regexp_replace(x, "-[0-9]+$", ""))
    return F.when(any_of(F.concat(s, plain), PEOPLE), "people").when(any_of(s, NEWS), "news").when(any_of(s, EVENTS), "event").otherwise("policy")


#: What a title tells about the part that somebody has, in order; all else is staff.
CATEGORIES = [("faculty", f"{OPEN}(professor|lecturer){SHUT}"), ("emeritus", f"{OPEN}emerit"), ("admin", f"{OPEN}dean{SHUT}"), ("advisor", f"{OPEN}advis")]
#: Ranks from the head of a unit down.
RANKS = ("Department Chair", "Distinguished Professor", "Professor", "Associate Professor", "Assistant Professor", "Senior University Lecturer", "University Lecturer")


def role_category(titles: Column) -> Column:
    """The category of an array of titles: the first rule that any of them meets."""
    t = F.lower(F.concat_ws(" ; ", titles))
    told = F.coalesce(*(F.when(F.rlike(t, F.lit(p)), name) for name, p in CATEGORIES))
    return F.coalesce(told, F.lit("staff"))


def seniority(title: Column, ranks: tuple[str, ...] = RANKS) -> Column:
    """A struct (rank, label): the head of a unit first, then the longest rank that the title holds, then a dean as a professor, then the rest."""
    t = F.lower(F.coalesce(title, F.lit("")))
    label = lambda i, name: F.struct(F.lit(i).alias("rank"), F.lit(name).alias("label"))
    by_length = sorted(enumerate(ranks[1:], 1), key=lambda r: -len(r[1]))
    told = F.when(F.contains(t, F.lit(ranks[0].lower())), label(0, ranks[0]))
    for i, name in by_length:
        told = told.when(F.contains(t, F.lit(name.lower())), label(i, name))
    return told.when(F.contains(t, F.lit("dean")), label(ranks.index("Professor"), "Professor")).otherwise(label(len(ranks), "Faculty"))
