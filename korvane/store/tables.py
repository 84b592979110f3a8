"""Keyed tables on shared storage: batches are merged in, every change is on record, every version stays readable.

A table is a folder. ``log/<version>.json`` names the Parquet folders that make up a version: one for each bucket of
keys, and the audit rows of all versions so far. A merge reads only the buckets that the batch touches, writes new folders
beside the old ones, and becomes visible by the one rename that puts its log entry in place; of two writers of one
version the second fails. A job that dies before leaves files that no version names (``vacuum`` removes them). A batch
has a name, and a batch that is already in the log changes nothing when it comes again.

Defined results: rows of a batch with a null key are refused (counted in ``refused`` of the log); of several rows of a batch
for one key the one with the highest ``order`` counts, ties going to the greater values; a row that changes nothing
leaves no audit row; deleting what is not there changes nothing; an empty batch makes a version without changes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPSERT, INSERT, DELETE = "upsert", "insert", "delete"
_BUCKET, _KIND, _ROW, _AUDIT = "_bucket", "_kind", "row", "audit"


class Conflict(Exception):
    """Another writer has put this version in place first."""


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where that is unset (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import atexit
        import shutil
        import tempfile

        own = tempfile.mkdtemp(prefix="korvane-store-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Files:
    """The few calls on the shared file system that a log needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Writes a file whole or not at all; False if the name is taken."""
        own = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(own), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        done = not self.fs.exists(self._path(name)) and self.fs.rename(self._path(own), self._path(name))
        if not done:
            self.fs.delete(self._path(own), False)
        return bool(done)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass
class Version:
    number: int = 0
    batch: str | None = None
    buckets: dict[str, str] = field(default_factory=dict)
    audit: list[str] = field(default_factory=list)
    refused: int = 0
    batches: list[str] = field(default_factory=list)


#: Names of batches that a log entry carries, so that a repeated one is known without reading the whole log.
REMEMBERED = 1000


class KeyedTable:
    """Rows of a schema under unique keys, in ``buckets`` parts by the hash of the key, or of those of its columns that ``place`` names."""

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType, keys: list[str], buckets: int = 16, place: list[str] | None = None):
        self.spark, self.root, self.keys, self.buckets, self.place = spark, root.rstrip("/"), keys, buckets, place or keys
        self.schema = spark.createDataFrame([], schema).schema
        self.values = [c for c in self.schema.names if c not in keys]
        self.files = Files(spark, root)
        self.audit_schema = T.StructType([*self.schema.fields, T.StructField("action", T.StringType()), T.StructField("version", T.LongType()), T.StructField("batch", T.StringType())])

    # reading

    def latest(self) -> int:
        return max((int(n[:-5]) for n in self.files.names("log") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def version(self, number: int | None = None) -> Version:
        number = self.latest() if number is None else number
        return Version(**json.loads(self.files.read(f"log/{number:012d}.json"))) if number else Version()

    def _load(self, folders: list[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{f}" for f in folders))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is named."""
        return self._load(list(self.version(number).buckets.values()), self.schema)

    def audit(self, number: int | None = None) -> DataFrame:
        """Every change up to a version: the new row (the old one for a delete), action, version and batch."""
        return self._load(self.version(number).audit, self.audit_schema)

    def history(self, number: int | None = None) -> DataFrame:
        """Each state of each key with the versions it held for: ``since`` (included) and ``until`` (excluded, null while it holds)."""
        from pyspark.sql import Window

        closed = F.lead("version").over(Window.partitionBy(*self.keys).orderBy("version"))
        rows = self.audit(number).withColumn("until", closed).where(F.col("action") != DELETE)
        return rows.select(*self.schema.names, F.col("version").alias("since"), "until")

    # writing

    def _place(self) -> Column:
        return F.pmod(F.hash(*(F.col(k).cast("string") for k in self.place)), F.lit(self.buckets))

    def merge(self, batch: DataFrame, name: str, op: Column | str = UPSERT, order: Column | None = None, keep_nulls: bool = False, set_values: dict[str, Column] | None = None) -> Version:
        """Brings a batch in; returns the version that holds it.

        ``op`` tells for each row whether it is an ``upsert``, an ``insert`` (which leaves a row that is there alone) or a
        ``delete``. With ``keep_nulls`` a null value keeps what is stored. ``set_values`` computes values from ``old`` and
        ``new``, structs of the stored and the coming row, either of which may be null.
        """
        at = self.version()
        if name in at.batches or self._in_log(name, at):
            return at
        rows = batch.withColumn("_op", F.lit(op) if isinstance(op, str) else op).withColumn("_order", F.lit(0) if order is None else order)
        whole = [F.col(k).isNotNull() for k in self.keys]
        valid = whole[0]
        for w in whole[1:]:
            valid = valid & w
        new = F.struct(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names))
        packed = rows.select(*(F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.keys), F.when(valid, F.struct("_order", "_op", new.alias("new"))).alias("row"), valid.alias("_valid"))
        # refused rows are counted on the way, so that the batch is computed once
        one = packed.groupBy(*self.keys, "_valid").agg(F.max("row").alias("top"), F.count("*").alias("_n")).select(*self.keys, "_valid", "_n", "top._op", "top.new")
        if isinstance(op, str) and op == INSERT and at.buckets:  # what is there already changes nothing and touches no bucket
            one = one.join(self._load(list(at.buckets.values()), self.schema).select(*self.keys), self.keys, "left_anti")
        step, out = uuid.uuid4().hex, f"{at.number + 1:012d}-"
        staged = f"{out}batch-{step}"
        one.withColumn(_BUCKET, self._place()).write.parquet(f"{self.root}/data/{staged}")
        batch_rows = self.spark.read.parquet(f"{self.root}/data/{staged}")
        met = batch_rows.groupBy(_BUCKET, "_valid").agg(F.sum("_n").alias("n")).collect()  # two rows a bucket at most
        touched, refused = sorted(r[_BUCKET] for r in met if r["_valid"]), sum(r["n"] for r in met if not r["_valid"])
        coming = batch_rows.where("_valid").drop("_valid", "_n")
        held = self._load([at.buckets[str(b)] for b in touched if str(b) in at.buckets], self.schema).select(*self.keys, F.struct(*self.schema.names).alias("old"))
        both = held.join(coming.drop(_BUCKET), self.keys, "full_outer")
        set_values = set_values or {}
        told = {c: set_values.get(c, F.coalesce(F.col("new")[c], F.col("old")[c]) if keep_nulls else F.col("new")[c]) for c in self.values}
        after = F.struct(*(F.col(c) if c in self.keys else told[c].cast(self.schema[c].dataType).alias(c) for c in self.schema.names))
        stays = F.col("_op").isNull() | ((F.col("_op") == INSERT) & F.col("old").isNotNull())
        row = F.when(stays, F.col("old")).when(F.col("_op") != DELETE, after)
        changed = both.select(*self.keys, "old", row.alias("row")).withColumn(
            "action",
            F.when(F.col("old").isNull() & F.col("row").isNull(), "none").when(F.col("old").isNull(), "insert").when(F.col("row").isNull(), DELETE).when(~F.col("old").eqNullSafe(F.col("row")), "update"),
        )
        made = f"{out}{step}"
        # rows of the table and of the audit are written in one pass, so that a late failure repeats no merge
        kinds = F.filter(F.array(F.when((F.col("action") != DELETE) | F.col("action").isNull(), F.lit(_ROW)), F.when(F.col("action").isNotNull(), F.lit(_AUDIT))), lambda k: k.isNotNull())
        settled = changed.where("row is not null or action = 'delete'").select(F.coalesce("row", "old").alias("row"), "action", *self.keys).withColumn(_BUCKET, self._place()).withColumn(_KIND, F.explode(kinds))
        extra = [F.when(F.col(_KIND) == _AUDIT, x).alias(n) for x, n in ((F.col("action"), "action"), (F.lit(at.number + 1).cast("long"), "version"), (F.lit(name), "batch"))]
        place = F.when(F.col(_KIND) == _AUDIT, -1).otherwise(F.col(_BUCKET)).alias(_BUCKET)
        settled.select("row.*", *extra, _KIND, place).write.partitionBy(_KIND, _BUCKET).parquet(f"{self.root}/data/{made}")
        written = set(self.files.names(f"data/{made}/{_KIND}={_ROW}"))
        buckets = {b: f for b, f in at.buckets.items() if int(b) not in touched}
        buckets |= {str(b): f"{made}/{_KIND}={_ROW}/{_BUCKET}={b}" for b in touched if f"{_BUCKET}={b}" in written}
        audit = [f"{made}/{_KIND}={_AUDIT}/{_BUCKET}=-1"] if self.files.names(f"data/{made}/{_KIND}={_AUDIT}") else []
        nxt = Version(at.number + 1, name, buckets, [*at.audit, *audit], refused, [*at.batches, name][-REMEMBERED:])
        self.files.delete(f"data/{staged}")
        if not self.files.put(f"log/{nxt.number:012d}.json", json.dumps(nxt.__dict__)):
            self.files.delete(f"data/{made}")
            raise Conflict(f"version {nxt.number} of {self.root} is already there")
        return nxt

    def replace(self, rows: DataFrame, touched: DataFrame, name: str) -> Version:
        """Puts ``rows`` (unique keys) in place of all rows whose place columns are among ``touched``; the rest stays. Leaves no audit rows.

        For batches that are whole by their place: rows are written once and meet no stored one by key. ``touched`` is a small table.
        """
        at = self.version()
        if name in at.batches or self._in_log(name, at):
            return at
        parts = sorted(r[_BUCKET] for r in touched.select(self._place().alias(_BUCKET)).distinct().collect())  # ``buckets`` rows at most
        old = [at.buckets[str(b)] for b in parts if str(b) in at.buckets]
        if old:
            rows = rows.unionByName(self._load(old, self.schema).join(F.broadcast(touched), self.place, "left_anti"))
        made = f"{at.number + 1:012d}-{uuid.uuid4().hex}"
        rows.select(*self.schema.names, self._place().alias(_BUCKET)).write.option("compression", "zstd").partitionBy(_BUCKET).parquet(f"{self.root}/data/{made}")
        written = set(self.files.names(f"data/{made}"))
        buckets = {b: f for b, f in at.buckets.items() if int(b) not in parts} | {str(b): f"{made}/{_BUCKET}={b}" for b in parts if f"{_BUCKET}={b}" in written}
        nxt = Version(at.number + 1, name, buckets, at.audit, 0, [*at.batches, name][-REMEMBERED:])
        if not self.files.put(f"log/{nxt.number:012d}.json", json.dumps(nxt.__dict__)):
            self.files.delete(f"data/{made}")
            raise Conflict(f"version {nxt.number} of {self.root} is already there")
        return nxt

    def _in_log(self, name: str, at: Version) -> bool:
        """Whether an older entry has the batch; asked only where the latest one does not remember all."""
        if len(at.batches) < REMEMBERED:
            return False
        return any(self.version(i).batch == name for i in range(at.number - REMEMBERED, 0, -1))

    # upkeep

    def vacuum(self, keep: int = 1) -> int:
        """Deletes log entries but the last ``keep`` and the folders that none of these names; returns how many folders went."""
        last = self.latest()
        kept = [self.version(i) for i in range(max(1, last - keep + 1), last + 1)]
        named = {f.split("/")[0] for v in kept for f in [*v.buckets.values(), *v.audit]}
        gone = [f for f in self.files.names("data") if f not in named]
        for f in gone:
            self.files.delete(f"data/{f}")
        for n in self.files.names("log"):
            if not (n.endswith(".json") and n[:-5].isdigit() and int(n[:-5]) > last - keep):
                self.files.delete(f"log/{n}")
        return len(gone)

    def compact_audit(self) -> Version:
        """One folder in place of an audit folder for each version; a version of its own."""
        at = self.version()
        made = f"{at.number + 1:012d}-{uuid.uuid4().hex}-audit"
        self.audit().write.parquet(f"{self.root}/data/{made}")
        nxt = Version(at.number + 1, None, at.buckets, [made], 0, at.batches)
        if not self.files.put(f"log/{nxt.number:012d}.json", json.dumps(nxt.__dict__)):
            raise Conflict(f"version {nxt.number} of {self.root} is already there")
        return nxt

    def drop(self) -> None:
        self.files.delete("")
