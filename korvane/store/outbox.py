"""Posts and their deliveries as stored tables: a scheduler's tick, publishing, unsending.

A post goes ``scheduled -> sending -> sent | failed``; a delivery of a sent post that is to be taken back ends as ``deleted``,
``delete_unsupported``, ``delete_failed`` or ``not_applicable``, or waits for another try while fewer than
:data:`ATTEMPTS` have failed. Every step is a merge of :mod:`korvane.store.tables` under the name of the tick or micro-batch, so
a step that comes again, after a crash or a restart from a checkpoint, changes nothing; what a step has done is read off the audit rows.

Defined results: outcomes of posts that are not being sent, and of deliveries that have ended, change nothing; outcomes with
null keys are refused; of one delivery the outcomes of a batch count in the order of ``seq``; a request without id or key
goes by the hash of its organisation, type and content, so the same request twice is one post.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from korvane.store.tables import INSERT, KeyedTable

POSTS = "key string, content string, status string, scheduled_for timestamp, sent_at timestamp, delete_at timestamp, deleted_at timestamp"
DELIVERIES = "key string, platform string, message string, status string, error string, delete_status string, delete_attempts int"
TEMPLATES = "template string, content string, enabled boolean, every_s long, next_run timestamp"
#: Tries to take a delivery back.
ATTEMPTS = 5
#: Parts of an error that mean that the message is gone already, and that it never can go.
GONE, UNSUPPORTED = ("not found", "unknown message"), "unsupported"


def dedup_key(source: Column, own_id: Column, key: Column, org: Column, kind: Column, content: Column) -> Column:
    """``source:id``, else ``source:key``, else ``source:auto:`` and the SHA-1 of organisation, type and content."""
    auto = F.concat(F.lit("auto:"), F.sha1(F.concat_ws("|", F.coalesce(org.cast("string"), F.lit("")), F.coalesce(kind, F.lit("")), F.coalesce(content, F.lit(""))).cast("binary")))
    return F.concat(source, F.lit(":"), F.coalesce(own_id.cast("string"), key, auto))


class Outbox:
    """The tables under one folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark = spark
        self.posts = KeyedTable(spark, f"{root}/posts", POSTS, ["key"], buckets)
        self.deliveries = KeyedTable(spark, f"{root}/deliveries", DELIVERIES, ["key", "platform"], buckets)
        self.templates = KeyedTable(spark, f"{root}/templates", TEMPLATES, ["template"], buckets)

    def enqueue(self, requests: DataFrame, name: str) -> DataFrame:
        """Takes requests (source, id, request_key, org, type, content, scheduled_for, delete_at); returns the posts that are new."""
        c = F.col
        key = dedup_key(c("source"), c("id"), c("request_key"), c("org"), c("type"), c("content"))
        rows = requests.select(key.alias("key"), "content", F.lit("scheduled").alias("status"), "scheduled_for", F.lit(None).alias("sent_at"), "delete_at", F.lit(None).alias("deleted_at"))
        return self._changed(self.posts, self.posts.merge(rows, name, INSERT).number, name)

    def _changed(self, table: KeyedTable, upto: int, name: str) -> DataFrame:
        return table.audit(upto).where(F.col("batch") == name).select(*table.schema.names)

    # the tick

    def tick(self, now: Column, name: str) -> DataFrame:
        """Makes posts of the templates that are due, then claims every post that is due; returns the claimed ones.

        A post without a time is due at once. A template's next run is its first one after ``now``, whatever runs were missed.
        """
        due = self.templates.read().where(F.col("enabled") & (F.col("next_run") <= now))
        stamp = F.date_format("next_run", "yyyy-MM-dd HH:mm:ss")
        rows = due.select(F.concat_ws(":", F.lit("template"), "template", stamp).alias("key"), "content", F.lit("scheduled").alias("status"), F.col("next_run").alias("scheduled_for"), *(F.lit(None).alias(x) for x in ("sent_at", "delete_at", "deleted_at")))
        self.posts.merge(rows, f"{name}/made", INSERT)
        late = F.unix_timestamp(now) - F.unix_timestamp("next_run")
        moved = F.timestamp_seconds(F.unix_timestamp("next_run") + (F.floor(late / F.col("every_s")) + 1) * F.col("every_s"))
        self.templates.merge(due.withColumn("next_run", moved), f"{name}/moved")
        ready = self.posts.read().where((F.col("status") == "scheduled") & (F.col("scheduled_for").isNull() | (F.col("scheduled_for") <= now)))
        claimed = self.posts.merge(ready.withColumn("status", F.lit("sending")), f"{name}/claimed")
        return self._changed(self.posts, claimed.number, f"{name}/claimed")

    # publishing

    def settle(self, outcomes: DataFrame, name: str) -> None:
        """Outcomes (key, platform, message, success, error, at) of the posts being sent: sent if any delivery succeeded, else failed."""
        known = self.posts.read().where("status = 'sending'")
        told = outcomes.join(known.select("key"), "key", "semi")
        status = F.when(F.col("success"), "success").otherwise("failed")
        rows = told.select("key", "platform", "message", status.alias("status"), "error", F.lit(None).alias("delete_status"), F.lit(0).alias("delete_attempts"), "at")
        self.deliveries.merge(rows, f"{name}/deliveries", INSERT, order=F.col("at"))
        ends = told.groupBy("key").agg(F.max(F.coalesce("success", F.lit(False))).alias("ok"), F.max("at").alias("last"))
        settled = known.join(ends, "key").withColumn("status", F.when(F.col("ok"), "sent").otherwise("failed")).withColumn("sent_at", F.col("last"))
        self.posts.merge(settled.select(*self.posts.schema.names), f"{name}/posts")

    # taking back

    def due_to_go(self, now: Column) -> DataFrame:
        """Deliveries that are to be taken back by now: of sent posts whose time is up, not yet ended."""
        posts = self.posts.read().where((F.col("status") == "sent") & (F.col("delete_at") <= now) & F.col("deleted_at").isNull())
        return self.deliveries.read().where("delete_status is null").join(posts.select("key"), "key", "semi")

    def unsend(self, outcomes: DataFrame, now: Column, name: str) -> None:
        """Outcomes (key, platform, seq, success, error, terminal) of tries to take deliveries back."""
        due = self.due_to_go(now)
        idle = (F.col("status") != "success") | F.coalesce("message", F.lit("")).isin("", "0", "None")
        never = due.where(idle).withColumn("delete_status", F.lit("not_applicable"))
        said = F.lower(F.coalesce("told", F.lit("")))
        gone = F.contains(said, F.lit(GONE[0])) | F.contains(said, F.lit(GONE[1]))
        verdict = F.when(F.col("success") | gone, "deleted").when(F.contains(said, F.lit(UNSUPPORTED)), "delete_unsupported").when(F.col("terminal"), "delete_failed")
        tries = outcomes.select("key", "platform", "seq", F.coalesce("success", F.lit(False)).alias("success"), F.coalesce("terminal", F.lit(False)).alias("terminal"), F.col("error").alias("told"))
        rows = due.where(~idle).join(tries, ["key", "platform"]).withColumn("verdict", verdict)
        sofar = Window.partitionBy("key", "platform").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        tried = F.col("delete_attempts") + F.sum(F.col("verdict").isNull().cast("int")).over(sofar)
        rows = rows.withColumn("tried", tried).withColumn("verdict", F.coalesce("verdict", F.when(F.col("tried") >= ATTEMPTS, "delete_failed")))
        # the first verdict ends a delivery; without one the last try stands
        first = F.struct(F.col("verdict").isNull().alias("open"), F.when(F.col("verdict").isNull(), -F.col("seq")).otherwise(F.col("seq")).alias("at"), "verdict", F.col("tried").cast("int").alias("tried"), "told")
        best = rows.groupBy("key", "platform").agg(F.min(first).alias("best"), F.first("message").alias("message"), F.first("status").alias("status"))
        error = F.when(F.coalesce("best.verdict", F.lit("")) != "deleted", F.col("best.told"))
        tried_rows = best.select("key", "platform", "message", "status", error.alias("error"), F.col("best.verdict").alias("delete_status"), F.col("best.tried").alias("delete_attempts"))
        self.deliveries.merge(never.select(*self.deliveries.schema.names).unionByName(tried_rows), f"{name}/tries")
        open_ = self.deliveries.read().where("delete_status is null").select("key")
        up = self.posts.read().where((F.col("status") == "sent") & (F.col("delete_at") <= now) & F.col("deleted_at").isNull())
        self.posts.merge(up.join(open_, "key", "anti").withColumn("deleted_at", now.cast("timestamp")), f"{name}/posts")

    def follow(self, outcomes: DataFrame, name: str, checkpoint: str, **trigger) -> StreamingQuery:
        """Settles a stream of outcomes batch by batch. Batches have the query's name and their number, so a replayed one is known."""

        def settle(batch: DataFrame, number: int) -> None:
            self.settle(batch, f"{name}-{number}")

        return outcomes.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
