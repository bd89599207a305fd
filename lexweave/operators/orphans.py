"""References to records that do not exist.

Both sides are change deltas folded against kept state. The state of a reference (table, record, key) is when it was first
held and whether its last change holds or retracts it; the state of an entity is when it first existed and whether its last
delivery withdraws it. A batch of deltas moves these states, and each move adds +1, 0 or -1 to the reference or existence
count of its key. A key with positive references and no existence is an orphan; a reference made before its key first
existed is one as well. States are maxima and minima and counts are sums of moves, so batches may be cut anywhere in time,
arrive late or arrive twice, and the counts are those of one batch with all rows.

All folds combine map-side, so a key that holds a third of the rows costs one partial row per task. References join only the
keys that can be orphans, and these are copied over ``SALT`` parts, so no task holds all references of one key.

Defined results: a null or blank key is no reference and no entity; a null record id stays a record of its own; equal
delivery times are settled by status (the larger string is taken as the later) and by the larger sign; a null time counts
as earlier than any other, and a reference without any time is never late; duplicates of a row change nothing; empty inputs
give empty outputs; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts over which the references of one key are spread in the join.
SALT = 16
WITHDRAWN = "withdrawn"
_REF = ("tbl", "rec_id", "ref_key")


def norm_key(key: Column) -> Column:
    """Keys match ignoring case and outer white space."""
    return F.lower(F.regexp_replace(key, r"^\s+|\s+$", ""))


def references(df: DataFrame, tbl: str, rec: str, keys: str, at: str, listed: bool, sign: str | None = None) -> DataFrame:
    """(tbl, rec_id, ref_key, ref_at, sign) of one table, one row for each delivery that holds the key.

    ``sign`` names a column that is negative in the rows that retract their keys; without it every row holds them.
    """
    key = F.explode(F.col(keys)) if listed else F.col(keys)
    given = F.when(F.col(sign) < 0, -1).otherwise(1) if sign else F.lit(1)
    out = df.select(F.lit(tbl).alias("tbl"), F.col(rec).cast("string").alias("rec_id"), F.col(at).alias("ref_at"), given.alias("sign"), key.alias("_k"))
    out = out.select("tbl", "rec_id", norm_key(F.col("_k")).alias("ref_key"), "ref_at", "sign")
    return out.where(F.col("ref_key").isNotNull() & (F.col("ref_key") != ""))


def entities(df: DataFrame, key: str = "id", at: str = "loaded_at", status: str = "status") -> DataFrame:
    """(ref_key, at, status) of every delivery of every record that may be referred to."""
    out = df.select(norm_key(F.col(key)).alias("ref_key"), F.col(at).alias("at"), F.col(status).alias("status"))
    return out.where(F.col("ref_key").isNotNull() & (F.col("ref_key") != ""))


@dataclass(frozen=True)
class State:
    """The kept state: ``refs`` (tbl, rec_id, ref_key, held_at, last), ``ents`` (ref_key, first_at, last), ``counts``
    (ref_key, refs, exists, known, first_ref, first_at)."""

    refs: DataFrame
    ents: DataFrame
    counts: DataFrame


def _holds(last: str) -> Column:
    return F.coalesce((F.col(f"{last}.sign") > 0).cast("int"), F.lit(0))


def _exists(last: str) -> Column:
    return F.coalesce((F.lower(F.trim(F.col(f"{last}.status"))) != WITHDRAWN).cast("int"), F.lit(0))


def _moved(kept: DataFrame | None, new: DataFrame, keys: tuple[str, ...], first: str) -> DataFrame:
    """New states by ``keys``: the earliest ``first``, the ``last`` change, and ``before``, the last change that was kept already."""
    if kept is None:
        return new.withColumn("before", F.lit(None).cast(dict(new.dtypes)["last"]))
    both = new.select(*keys, first, "last", F.lit(None).cast(dict(new.dtypes)["last"]).alias("before"))
    both = both.unionByName(kept.select(*keys, first, "last", F.col("last").alias("before")))
    return both.groupBy(*keys).agg(F.min(first).alias(first), F.max("last").alias("last"), F.max("before").alias("before"))


def advance(kept: State | None, refs: DataFrame, deliveries: DataFrame) -> State:
    """The state after a batch of reference and entity deltas; ``kept`` is None before the first one."""
    # equal hash partitions serve the fold, and the salt keeps one key's references in several of them
    part = F.pmod(F.xxhash64("tbl", "rec_id"), F.lit(SALT)).cast("int").alias("part")
    r = refs.groupBy("ref_key", part, "tbl", "rec_id").agg(
        F.min(F.when(F.col("sign") > 0, F.col("ref_at"))).alias("held_at"), F.max(F.struct("ref_at", "sign")).alias("last")
    )
    r = _moved(kept and kept.refs, r, ("ref_key", "part", "tbl", "rec_id"), "held_at")
    last = F.max(F.struct("at", F.coalesce("status", F.lit("")).alias("status"))).alias("last")
    e = _moved(kept and kept.ents, deliveries.groupBy("ref_key").agg(F.min("at").alias("first_at"), last), ("ref_key",), "first_at")
    none = F.lit(None).cast("timestamp")
    moves = r.select("ref_key", (_holds("last") - _holds("before")).alias("refs"), F.lit(0).alias("exists"), F.lit(0).alias("known"), F.col("held_at").alias("first_ref"), none.alias("first_at"))
    moves = moves.unionByName(
        e.select("ref_key", F.lit(0).alias("refs"), (_exists("last") - _exists("before")).alias("exists"), F.col("before").isNull().cast("int").alias("known"), none.alias("first_ref"), "first_at")
    )
    if kept is not None:
        moves = moves.unionByName(kept.counts)
    counts = moves.groupBy("ref_key").agg(*[F.sum(c).alias(c) for c in ("refs", "exists", "known")], *[F.min(c).alias(c) for c in ("first_ref", "first_at")])
    return State(r.drop("before"), e.drop("before"), counts)


def orphan_keys(counts: DataFrame) -> DataFrame:
    """(ref_key, refs, exists): keys with positive references and no existence."""
    return counts.where((F.col("refs") > 0) & (F.col("exists") <= 0)).select("ref_key", "refs", "exists")


def orphan_references(state: State) -> DataFrame:
    """(tbl, rec_id, ref_key, ref_at, reason): references whose key is absent, withdrawn or was loaded only later."""
    c = state.counts.where((F.col("refs") > 0) & ((F.col("exists") <= 0) | (F.col("first_at") > F.col("first_ref"))))
    parts = F.explode(F.array(*[F.lit(i) for i in range(SALT)])).alias("part")
    suspects = c.select("ref_key", "exists", "known", "first_at", parts)
    held = state.refs.where(_holds("last") > 0).select("ref_key", "part", "tbl", "rec_id", F.col("held_at").alias("ref_at"))
    reason = F.when(F.col("known") == 0, "absent").when(F.col("exists") <= 0, "withdrawn").when(F.col("first_at") > F.col("ref_at"), "late")
    out = held.join(suspects, ["ref_key", "part"]).select(*_REF, "ref_at", reason.alias("reason"))
    return out.where(F.col("reason").isNotNull())


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table and month of the reference."""
    month = F.date_format("ref_at", "yyyy-MM").alias("month")
    return orphans.groupBy("tbl", month).agg(F.count("*").alias("orphans"), F.count_distinct("ref_key").alias("orphan_keys"))


class Ledger:
    """The state as tables in a shared folder, one version for each batch; a batch that is applied twice counts once.

    ``apply`` fits ``foreachBatch``: a version is valid from the moment its marker is written, older ones stay until
    ``keep`` newer ones exist.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *map(str, parts)]))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path()):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path())]
        return sorted(int(f) for f in found if f.isdigit() and self._fs.exists(self._path(f, "done")))

    def state(self) -> State | None:
        have = self.versions()
        if not have:
            return None
        read = lambda name: self.spark.read.parquet(f"{self.folder}/{have[-1]}/{name}")
        return State(read("refs"), read("ents"), read("counts"))

    def apply(self, refs: DataFrame, deliveries: DataFrame, batch: int) -> None:
        have = self.versions()
        if have and batch <= have[-1]:
            return
        new = advance(self.state(), refs, deliveries)
        for name in ("refs", "ents", "counts"):
            getattr(new, name).write.mode("overwrite").parquet(f"{self.folder}/{batch}/{name}")
        self._fs.create(self._path(batch, "done")).close()
        for old in have[: max(0, len(have) + 1 - self.keep)]:
            self._fs.delete(self._path(old), True)
