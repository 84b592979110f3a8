"""Hybrid retrieval over a batch of questions: keyword and vector legs, fusion, re-ranking, diversification, expansion.

Operators take DataFrames. Documents are (doc_id, text, ...), vectors (vec_id, embedding, ...), questions (item_id, text)
or, for the vector legs, (item_id, embedding). Ranked results are (item_id, doc_id, score, place).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korvane.operators.lineage import cut

#: Constants of the public BM25 formulas and of reciprocal rank fusion.
K1, B, FLOOR = 1.2, 0.75, 1e-6
OKAPI_K1, OKAPI_FLOOR = 1.5, 0.25
FUSE, RERANK_FUSE = 60, 10
LEG, RERANK, ANSWERS, CAP = 40, 20, 5, 4096
#: Words that carry no content; a question of nothing else is asked with all its words.
STOP = ("an", "and", "are", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "who", "with")
#: Vectors and questions that meet in one task's matrix product.
SLICE, BLOCK = 1024, 2048
#: Rows (of a number or a word and a number or two) up to which a table is sent to every task.
SMALL = 500_000


def quantised(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5) / 1e6


def tokens(text: Column) -> Column:
    """Runs of two and more ASCII letters or digits, lower-cased; none of a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{2,})"), F.lit(1))


def asked_tokens(questions: DataFrame) -> DataFrame:
    """item_id and each distinct content token of the whole question; all tokens where no content is left."""
    every = questions.select("item_id", F.array_distinct(tokens(F.col("text"))).alias("ts"))
    content = F.filter("ts", lambda t: ~t.isin(*STOP))
    return every.select("item_id", F.explode(F.when(F.size(content) > 0, content).otherwise(F.col("ts"))).alias("token"))


def best(scored: DataFrame, k: int, descending: bool = True) -> DataFrame:
    """The k best of each question with their place, ties to the smaller id."""
    w = Window.partitionBy("item_id").orderBy(F.desc("score") if descending else F.asc("score"), "doc_id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _beside(df: DataFrame) -> DataFrame:
    """``df``, sent to every task if it is small; else left to a shuffle."""
    return F.broadcast(df) if df.count() <= SMALL else df


#: Pairs of a question and a document that a task sums at once, and what stands for a document without id.
PAIRS, NONE = 1 << 20, np.iinfo(np.int64).min


def _firsts(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each question, ties to the smaller id."""
    o = np.lexsort((doc, -score, item))
    own = item[o]
    o = o[np.arange(len(o)) - np.searchsorted(own, own) < k]
    return item[o], doc[o], score[o]


def _summed(weights: pa.Table, k: int, k1: float, mean: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole documents (doc_id, held: their tokens with n and tf) to a task's k best of each question of ``weights`` (item_id, token, idf)."""
    weights = weights.sort_by("token").combine_chunks()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = weights["item_id"].combine_chunks().dictionary_encode()
        items, whose, idf = coded.dictionary, coded.indices.to_numpy(), weights["idf"].to_numpy()
        known = weights["token"].combine_chunks().dictionary_encode()
        size = np.bincount(known.indices.to_numpy(), minlength=len(known.dictionary))
        start = np.cumsum(size) - size
        top, least = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.full(len(items), -np.inf)
        for b in it:
            held = b.column(1)
            flat, ids = held.flatten(), pc.fill_null(b.column(0).cast(pa.int64()), NONE).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False))
            code = pc.fill_null(pc.index_in(flat.field("token"), value_set=known.dictionary), -1).to_numpy(zero_copy_only=False)
            keep = code >= 0
            row, code, tf, n = row[keep], code[keep], flat.field("tf").to_numpy()[keep], flat.field("n").to_numpy()[keep]
            part = tf * (k1 + 1) / (tf + k1 * (1 - B + B * n / mean))
            upto = np.cumsum(np.bincount(row, weights=size[code], minlength=len(held)))  # pairs of the documents up to each
            edges = np.unique(np.concatenate([[0], np.searchsorted(upto, np.arange(PAIRS, upto[-1] if len(upto) else 0, PAIRS)), [len(held)]]))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                x, y = np.searchsorted(row, (lo, hi))
                many = size[code[x:y]]
                own = np.repeat(np.arange(x, y), many)
                at = np.repeat(start[code[x:y]] - np.cumsum(many) + many, many) + np.arange(len(own))
                pair, back = np.unique(row[own] * len(items) + whose[at], return_inverse=True)
                score = np.floor(np.bincount(back, weights=idf[at] * part[own], minlength=len(pair)) * 1e6 + 0.5) / 1e6
                item, doc = pair % len(items), ids[pair // len(items)]
                good = score >= least[item]
                top = _firsts(*(np.concatenate(p) for p in zip(top, (item[good], doc[good], score[good]), strict=True)), k)
                full = np.flatnonzero(np.bincount(top[0], minlength=len(items)) >= k)
                least[full] = top[2][np.searchsorted(top[0], full, side="right") - 1]
        yield pa.RecordBatch.from_arrays([items.take(pa.array(top[0])), pa.array(top[1], pa.int64(), mask=top[1] == NONE), pa.array(top[2], pa.float64())], names=["item_id", "doc_id", "score"])

    return run


def bm25(docs: DataFrame, questions: DataFrame, k: int = LEG, allowed: DataFrame | None = None, okapi: bool = False) -> DataFrame:
    """The k best documents of each question by BM25, in one pass over the texts.

    Every text adds a marker token, which carries the number of documents and their mean length. Only asked tokens are
    shuffled, once, by document, and written, a row a document. Up to :data:`SMALL` weights go to the documents, and a task sums
    :data:`PAIRS` pairs at once and hands on k a question; more weights are joined and their pairs shuffled. ``allowed``
    (doc_id) restricts what may be found; the corpus statistics stay those of all documents. ``okapi`` takes the
    Okapi constants and lifts negative weights to a quarter of the mean one.
    """
    asked = cut(asked_tokens(questions))
    wanted = _beside(asked.select("token").union(docs.sparkSession.createDataFrame([("",)], "token string")).distinct())
    marked = docs.select("doc_id", tokens(F.col("text")).alias("ts")).select("doc_id", F.size("ts").alias("n"), F.explode(F.concat("ts", F.array(F.lit("")))).alias("token"))
    counted = marked.join(wanted, "token", "left_semi").repartition("doc_id").groupBy("doc_id", "n", "token").agg(F.count("*").alias("tf"))
    whole = cut(counted.groupBy("doc_id").agg(F.collect_list(F.struct("n", "token", "tf")).alias("held")))  # an entry for each asked token of a document
    postings = whole.select("doc_id", F.inline("held"))
    held = postings.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("length"))
    size = held.where("token = ''").first()  # one row of totals
    total, mean = (size["df"], size["length"] / size["df"]) if size else (0, 0.0)
    raw = F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = cut(asked.join(held.where("token <> ''").withColumn("raw", raw), "token").select("item_id", "token", "raw"))
    if okapi:
        typical = weights.select("token", "raw").distinct().agg(F.avg("raw")).first()[0] or 0.0
        idf, k1 = F.when(F.col("raw") < 0, OKAPI_FLOOR * typical).otherwise(F.col("raw")), OKAPI_K1
    else:
        idf, k1 = F.greatest("raw", F.lit(FLOOR)), K1
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - B + B * F.col("n") / F.lit(mean)))
    found = whole if allowed is None else whole.join(_beside(allowed.select("doc_id").distinct()), "doc_id", "left_semi")
    told = weights.select("item_id", "token", idf.alias("idf"))
    if isinstance(docs.schema["doc_id"].dataType, (T.LongType, T.IntegerType)) and told.count() <= SMALL:
        schema = T.StructType([told.schema["item_id"], docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
        return best(found.mapInArrow(_summed(told.toArrow(), k, k1, mean or 1.0), schema), k)
    scored = found.select("doc_id", F.inline("held")).join(told, "token").groupBy("item_id", "doc_id").agg(quantised(F.sum(part)).alias("score"))
    return best(scored, k)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


#: What a task does with questions: a step for each slice of vectors (ids, rows of numbers), which may hand on rows at once, and a table at its end.
Fold = Callable[[pa.Table, np.ndarray], tuple[Callable[[np.ndarray, np.ndarray], pa.Table | None], Callable[[], pa.Table]]]


def _swept(vectors: DataFrame, questions: DataFrame, fold: Fold, schema: str) -> DataFrame:
    """Questions, :data:`BLOCK` at a time, are sent to the vectors, which stay where they lie; a task hands on what it has folded them to.

    A block is all that the driver and a task hold of the questions. Vectors are compared with questions of their length. With more
    blocks than one, each block's result is written before the next is sent.
    """
    asked = cut(questions.dropDuplicates(["item_id"]).withColumn("_size", F.size("q")))
    sizes = {r["_size"]: r["n"] for r in asked.groupBy("_size").agg(F.count("*").alias("n")).collect()}  # a row a length
    parts: list[DataFrame] = []
    for size, n in sorted(sizes.items()):
        blocks = -(-n // BLOCK)
        own = vectors.where(F.size("v") == size).select("doc_id", "v")
        for i in range(blocks):
            block = asked.where((F.col("_size") == size) & (F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)).drop("_size").toArrow()
            if block.num_rows:
                parts.append(own.mapInArrow(_folded(block, fold), schema))
                if blocks > 1:
                    parts[-1] = cut(parts[-1])
    out = parts[0] if parts else vectors.sparkSession.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _folded(block: pa.Table, fold: Fold) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, done = fold(block, _matrix(block["q"]))
        for b in it:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                if (out := step(part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1)))) is not None:
                    yield from out.to_batches()
        yield from done().to_batches()

    return run


def usable(column: str) -> Column:
    """Whether a vector can be compared: it has numbers, and none is missing or not finite."""
    return F.coalesce((F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _prepared(vectors: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = vectors.where(usable("embedding")).select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    return v, questions.where(usable("embedding")).select("item_id", F.col("embedding").cast("array<double>").alias("q"))


def _scores(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Questions by vectors: inner product or cosine (higher is nearer), or the L2 distance."""
    if metric == "cosine":
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
    dot = y @ x.T
    if metric != "l2":
        return np.floor(dot * 1e6 + 0.5) / 1e6
    square = (y * y).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * dot
    return np.floor(np.sqrt(np.maximum(square, 0)) * 1e6 + 0.5) / 1e6


def nearest(vectors: DataFrame, questions: DataFrame, k: int = LEG, metric: str = "l2") -> DataFrame:
    """The k nearest vectors of each question, exactly; a filter on ``vectors`` comes before the choice."""
    v, q = _prepared(vectors, questions)

    def fold(b: pa.Table, y: np.ndarray):
        items, held = b["item_id"].to_numpy(), [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # question, vector, key

        def step(ids: np.ndarray, x: np.ndarray) -> None:
            key = _scores(metric, x, y) if metric == "l2" else -_scores(metric, x, y)
            last = np.partition(key, k - 1, axis=1)[:, k - 1 : k] if k < key.shape[1] else np.full((len(key), 1), np.inf)
            row, col = np.nonzero(key <= last)
            own = [np.concatenate(p) for p in zip(held, (row, ids[col], key[row, col]), strict=True)]
            order = np.lexsort((own[1], own[2], own[0]))
            own = [p[order] for p in own]
            first = np.searchsorted(own[0], own[0])  # where each question's results begin
            keep = np.arange(len(order)) - first < k
            held[:] = [p[keep] for p in own]

        def done() -> pa.Table:
            score = held[2] if metric == "l2" else -held[2]
            return pa.table({"item_id": pa.array(items[held[0]], pa.int64()), "doc_id": pa.array(held[1], pa.int64()), "score": pa.array(score, pa.float64())})

        return step, done

    return best(_swept(v, q, fold, "item_id long, doc_id long, score double"), k, metric != "l2")


def similarity(distance: Column) -> Column:
    """The cosine of unit vectors at an L2 distance, never under 0."""
    return F.greatest(F.lit(0.0), 1 - distance * distance / 2)


def fused(semantic: DataFrame, keyword: DataFrame, k: int = ANSWERS) -> DataFrame:
    """(item_id, doc_id, score, source, place): two ranked legs fused by reciprocal ranks."""
    a, b = semantic.select("item_id", "doc_id", F.col("place").alias("pa")), keyword.select("item_id", "doc_id", F.col("place").alias("pb"))
    both = a.join(b, ["item_id", "doc_id"], "full_outer")
    score = F.coalesce(1.0 / (FUSE + F.col("pa")), F.lit(0.0)) + F.coalesce(1.0 / (FUSE + F.col("pb")), F.lit(0.0))
    source = F.when(F.col("pa").isNull(), "keyword").when(F.col("pb").isNull(), "semantic").otherwise("hybrid")
    return best(both.select("item_id", "doc_id", (F.floor(score * 1e9 + 0.5) / 1e9).alias("score"), source.alias("source")), k)


def hybrid(docs: DataFrame, vectors: DataFrame, questions: DataFrame, k: int = ANSWERS, allowed: DataFrame | None = None) -> DataFrame:
    """Both legs, each restricted to ``allowed`` before it chooses, fused. ``questions`` hold item_id, text and embedding."""
    near = vectors if allowed is None else vectors.join(allowed.select(F.col("doc_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    return fused(nearest(near, questions), bm25(docs, questions, allowed=allowed), k)


def normalised(ranked: DataFrame, low: float = 0.40, high: float = 0.95) -> DataFrame:
    """(item_id, doc_id, score): scores spread over ``low`` to ``high`` within a question; 1.0 where all are equal."""
    w = Window.partitionBy("item_id")
    least, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    return ranked.select("item_id", "doc_id", quantised(F.when(span == 0, 1.0).otherwise(low + (high - low) * (F.col("score") - least) / span)).alias("score"))


def reranked(ranked: DataFrame, scores: DataFrame, prior: DataFrame | None = None, head: int = RERANK) -> DataFrame:
    """(item_id, doc_id, slot): the first ``head`` places fused anew with a second ranker's scores (item_id, doc_id, rescore), which count more, times a prior (doc_id, prior); later places keep their order. A pair without a score is ranked behind those with one."""
    second = Window.partitionBy("item_id").orderBy(F.col("rescore").desc_nulls_last(), "doc_id")
    front = ranked.where(F.col("place") <= head).select("item_id", "doc_id", "place").join(scores.select("item_id", "doc_id", "rescore"), ["item_id", "doc_id"], "left")
    front = front.withColumn("again", F.row_number().over(second))
    front = front.withColumn("prior", F.lit(1.0)) if prior is None else front.join(prior, "doc_id", "left").withColumn("prior", F.coalesce("prior", F.lit(1.0)))
    fresh = F.floor((1.0 / (FUSE + F.col("place")) + 1.0 / (RERANK_FUSE + F.col("again"))) * F.col("prior") * 1e9 + 0.5) / 1e9
    slot = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("fresh"), "place"))
    tail = ranked.where(F.col("place") > head).select("item_id", "doc_id", F.col("place").alias("slot"))
    return front.withColumn("fresh", fresh).select("item_id", "doc_id", slot.alias("slot")).union(tail)


def pair_scores(pairs: DataFrame, vectors: DataFrame, questions: DataFrame) -> DataFrame:
    """(item_id, doc_id, rescore): the inner product of each pair; a pair without vectors has none."""
    v, q = _prepared(vectors, questions)
    dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return pairs.select("item_id", "doc_id").join(v.select("doc_id", "v"), "doc_id").join(q, "item_id").select("item_id", "doc_id", quantised(dot).alias("rescore"))


def diversified(ranked: DataFrame, entities: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, doc_id, entity, slot): results dealt round-robin over entities (doc_id, entity): the best of each, best entity first, then the second of each. A result without entity is its own."""
    rows = ranked.select("item_id", "doc_id", "place").join(entities, "doc_id", "left").withColumn("group", F.coalesce("entity", F.concat(F.lit("#"), "doc_id")))
    own = Window.partitionBy("item_id", "group")
    rows = rows.withColumn("turn", F.row_number().over(own.orderBy("place"))).withColumn("lead", F.min("place").over(own))
    slot = F.row_number().over(Window.partitionBy("item_id").orderBy("turn", "lead"))
    return rows.withColumn("slot", slot).where(F.col("slot") <= k).select("item_id", "doc_id", "entity", "slot")


def expanded(results: DataFrame, profiles: DataFrame) -> DataFrame:
    """(item_id, doc_id, slot, expanded): before an entity's first result comes its profile (entity, profile_id), unless the profile is among the results."""
    first = results.where("entity is not null").groupBy("item_id", "entity").agg(F.min("slot").alias("slot"))
    held = results.select("item_id", F.col("doc_id").alias("profile_id"))
    added = first.join(profiles, "entity").join(held, ["item_id", "profile_id"], "left_anti").select("item_id", F.col("profile_id").alias("doc_id"), "slot", F.lit(True).alias("expanded"))
    both = results.select("item_id", "doc_id", "slot", F.lit(False).alias("expanded")).unionByName(added)
    w = Window.partitionBy("item_id").orderBy("slot", F.desc("expanded"), "doc_id")
    return both.select("item_id", "doc_id", F.row_number().over(w).alias("slot"), "expanded")


def best_children(vectors: DataFrame, questions: DataFrame, parents: DataFrame, k: int = ANSWERS, fetch: int = LEG, least: int = ANSWERS, cap: int = CAP) -> DataFrame:
    """(item_id, parent, score, slot, fetched): the best child of each parent (doc_id, parent) among the ``fetched`` nearest children.

    ``fetched`` starts at ``fetch`` and doubles until ``least`` parents are among the children, or ``cap`` is reached. Only the
    questions that still lack parents are asked again.
    """
    todo, number, told = cut(questions.select("item_id", "embedding").dropDuplicates(["item_id"])), fetch, []
    while True:
        ranked = nearest(vectors, todo, number).join(parents, "doc_id")
        opens = cut(ranked.groupBy("item_id", "parent").agg(F.min("score").alias("score")).withColumn("fetched", F.lit(number)))
        if number >= cap:
            told.append(opens)
            break
        enough = opens.groupBy("item_id").count().where(F.col("count") >= least).select("item_id")
        told.append(opens.join(enough, "item_id", "left_semi"))
        todo = cut(todo.join(enough, "item_id", "left_anti"))
        if not todo.limit(1).count():
            break
        number = min(cap, 2 * number)
    kept = told[0]
    for t in told[1:]:
        kept = kept.unionByName(t)
    w = Window.partitionBy("item_id").orderBy("score", "parent")
    return kept.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= k).select("item_id", "parent", "score", "slot", "fetched")


def exemplar_decision(exemplars: DataFrame, questions: DataFrame, each: int = 8, least: float = 0.3, margin: float = 0.02) -> DataFrame:
    """(item_id, label, score, margin, decision): the label of the nearest of at most ``each`` exemplars a label; ``clarify`` under a score or a lead."""
    few = exemplars.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where(F.col("r") <= each)
    labels = few.select(F.col("vec_id").alias("doc_id"), "label")
    by_label = nearest(few, questions, CAP, "ip").join(labels, "doc_id").groupBy("item_id", "label").agg(F.max("score").alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "label")
    ranked = by_label.withColumn("r", F.row_number().over(w)).withColumn("margin", quantised(F.col("score") - F.lead("score").over(w)))
    decision = F.when((F.col("score") < least) | (F.col("margin") < margin), "clarify").otherwise("route")
    return ranked.where("r = 1").select("item_id", "label", "score", "margin", decision.alias("decision"))


def nearest_description(descriptions: DataFrame, questions: DataFrame, least: float = 0.60) -> DataFrame:
    """(item_id, label, score): the label of the description nearest by cosine; no label under ``least``."""
    top = nearest(descriptions, questions, 1, "cosine").join(descriptions.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    return top.select("item_id", F.when(F.col("score") >= least, F.col("label")).alias("label"), "score")


def candidate_tags(tags: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, tag): tags (tag, vec_id, embedding) among the k nearest by cosine, and those that share a token of three letters or more with the question, joined and sorted."""
    near = nearest(tags, questions, k, "cosine").join(tags.select(F.col("vec_id").alias("doc_id"), "tag"), "doc_id").select("item_id", "tag")
    held = tags.select("tag", F.explode(F.array_distinct(tokens(F.col("tag")))).alias("token")).where(F.length("token") > 2)
    shared = asked_tokens(questions).join(held, "token").select("item_id", "tag")
    return near.union(shared).distinct().orderBy("item_id", "tag")


def target_rank(vectors: DataFrame, questions: DataFrame, targets: DataFrame) -> DataFrame:
    """(item_id, target_rank): one more than the vectors strictly nearer, by inner product, than the question's target (item_id, target_id)."""
    v, q = _prepared(vectors, questions)
    wanted = targets.join(v.select(F.col("doc_id").alias("target_id"), F.col("v").alias("t")), "target_id").select("item_id", "t")

    def fold(b: pa.Table, y: np.ndarray):
        goal = np.floor((y * _matrix(b["t"])).sum(axis=1) * 1e6 + 0.5) / 1e6
        nearer = np.zeros(len(goal), np.int64)

        def step(ids: np.ndarray, x: np.ndarray) -> None:
            nearer[:] += (_scores("ip", x, y) > goal[:, None]).sum(axis=1)

        return step, lambda: pa.table({"item_id": b["item_id"].cast(pa.int64()), "nearer": pa.array(nearer, pa.int64())})

    counts = _swept(v, q.join(wanted, "item_id").where(F.size("q") == F.size("t")), fold, "item_id long, nearer long")
    return counts.groupBy("item_id").agg((F.sum("nearer") + 1).alias("target_rank"))
