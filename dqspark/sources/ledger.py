"""Clean and quarantine tables whose runs are committed together.

    <root>/clean/run=<id>/bucket=<b>/      rows, laid out by a hash of the key
    <root>/filter/run=<id>/                bits of the keys' hashes by bucket
    <root>/quarantine/run=<id>/
    <root>/runs/<id>.json                  what the run wrote; its appearance commits the run

A run writes its folders first and its manifest last, by one rename.  Readers look at manifests
and read named runs only, so a run that dies in between has left nothing that counts.  The
manifest carries one time for both tables.

Insert-if-absent needs to know which keys are there.  Every run leaves a bitmap of its keys'
hashes, ``filter_bits`` a bucket.  A new batch is held against the bitmaps of its buckets; a key
whose bit is not set is new without a look at the clean table.  Only for the others are keys
read, and only from the buckets they fall into.  More bits mean fewer such keys; the answer is
exact in any case.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from dqspark.operators.contract import SEQ
from dqspark.sources.durable import pin
from dqspark.sources.sinks import first_per_key, quarantine_records

BUCKETS, FILTER_BITS = 256, 1 << 20
#: Bits in one value of Spark's bitmap functions.
_CELL = 32_768


class Ledger:
    """One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str, key: str = "company_id", buckets: int = BUCKETS, filter_bits: int = FILTER_BITS):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        known = self.manifests()
        if known:  # the layout is that of the first run
            buckets, filter_bits = known[0]["buckets"], known[0]["filter_bits"]
        self.buckets, self.filter_bits = buckets, filter_bits

    # -- runs ---------------------------------------------------------------------------

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), target

    def manifests(self) -> list[dict]:
        """The committed runs, oldest first; one small file each."""
        fs, folder = self._fs(f"{self.root}/runs")
        if not fs.exists(folder):
            return []
        out = []
        for status in fs.listStatus(folder):
            if status.getPath().getName().endswith(".json"):
                stream = fs.open(status.getPath())
                try:
                    out.append(json.loads(bytes(stream.readAllBytes())))
                finally:
                    stream.close()
        return sorted(out, key=lambda m: m["number"])

    def runs(self) -> DataFrame:
        """(number, run, loaded_at, clean, quarantine) of the committed runs."""
        rows = [(m["number"], m["run"], m["loaded_at"], m["clean"], m["quarantine"]) for m in self.manifests()]
        made = self.spark.createDataFrame(rows, "number bigint, run string, loaded_at string, clean bigint, quarantine bigint")
        return made.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))

    def _read(self, part: str) -> DataFrame | None:
        """A table's committed runs; None before the first run that wrote any of it."""
        named = [m for m in self.manifests() if m[part if part != "filter" else "clean"]]
        if not named:
            return None
        schema = StructType.fromJson(json.loads(named[0][f"{part}_schema"]))
        extra = [StructField("run", StringType()), *([StructField("bucket", IntegerType())] if part == "clean" else [])]
        read = self.spark.read.schema(StructType([*schema.fields, *extra])).parquet(f"{self.root}/{part}")
        return read.filter(F.col("run").isin([m["run"] for m in named]))

    def clean(self) -> DataFrame | None:
        """All clean rows, with the run that wrote them and their bucket."""
        return self._read("clean")

    def quarantine(self) -> DataFrame | None:
        return self._read("quarantine")

    # -- insert if absent ---------------------------------------------------------------

    def _hash(self) -> Column:
        return F.xxhash64(F.col(self.key).cast("string"))

    def bucket(self) -> Column:
        return F.pmod(self._hash(), F.lit(self.buckets)).cast("int")

    def _bit(self) -> Column:
        return F.pmod(F.shiftrightunsigned(self._hash(), 20), F.lit(self.filter_bits).cast("bigint"))

    def _marked(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({
            "bucket": self.bucket(), "__cell": F.floor(self._bit() / _CELL).cast("int"), "__at": (self._bit() % _CELL).cast("int")})

    def suspects(self, incoming: DataFrame) -> DataFrame:
        """(key, bucket) of the incoming keys whose bit is set by an earlier run."""
        marked = self._marked(incoming.select(self.key)).distinct()
        held = self._read("filter")
        if held is None:
            return marked.limit(0).select(self.key, "bucket")
        bits = held.groupBy("bucket", "cell").agg(F.bitmap_or_agg("bits").alias("bits"))
        both = marked.join(bits.withColumnRenamed("cell", "__cell"), ["bucket", "__cell"])
        byte = F.conv(F.hex(F.expr("substring(bits, __at div 8 + 1, 1)")), 16, 10).cast("int")
        mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.col("__at") % 8 + 1)
        return both.filter(byte.bitwiseAND(mask) > 0).select(self.key, "bucket")

    def known_keys(self, suspects: DataFrame) -> DataFrame | None:
        """Stored keys in the buckets of the suspects; None if nothing needs to be read."""
        buckets = sorted(r["bucket"] for r in suspects.select("bucket").distinct().collect())
        held = self.clean()
        if held is None or not buckets:
            return None
        return held.filter(F.col("bucket").isin(buckets)).select(self.key)

    def absent(self, incoming: DataFrame, seq: str = SEQ) -> DataFrame:
        """First row of each key of a written batch whose key no committed run has."""
        first = first_per_key(incoming, self.key, seq)
        suspects = pin(self.suspects(incoming), "suspects")
        known = self.known_keys(suspects)
        if known is None:
            return first
        there = suspects.select(self.key).join(known, self.key, "left_semi")
        return first.join(there, self.key, "left_anti").select(*first.columns)

    # -- writing ------------------------------------------------------------------------

    def stage(self, records: DataFrame, rejected: DataFrame, run: str) -> dict:
        """Write a run's folders; nothing counts yet."""
        before = self.manifests()
        if SEQ not in records.columns:
            records = records.withColumn(SEQ, F.monotonically_increasing_id())
        new = self.absent(pin(records, "records")).drop(SEQ)
        clean = pin(new.withColumn("bucket", self.bucket()), "clean")
        n_clean = clean.count()
        manifest = {
            "run": run, "number": before[-1]["number"] + 1 if before else 1, "after": before[-1]["run"] if before else None,
            "buckets": self.buckets, "filter_bits": self.filter_bits, "clean": n_clean, "quarantine": 0,
            "clean_schema": clean.drop("bucket").schema.json(),
        }
        if n_clean:
            clean.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/clean/run={run}")
            bits = self._marked(clean).groupBy("bucket", F.col("__cell").alias("cell")).agg(F.bitmap_construct_agg("__at").alias("bits"))
            bits.write.parquet(f"{self.root}/filter/run={run}")
            manifest["filter_schema"] = bits.schema.json()
        last = max((m.get("last_id", 0) for m in before), default=0)
        bad = pin(quarantine_records(rejected, last + 1), "quarantine")
        got = bad.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).first()
        manifest |= {"quarantine": got["n"], "last_id": got["last"] or last, "quarantine_schema": bad.schema.json()}
        if got["n"]:
            bad.write.parquet(f"{self.root}/quarantine/run={run}")
        return manifest

    def commit(self, manifest: dict) -> None:
        """Name the run, if no other was named since it was staged."""
        now = self.manifests()
        if (now[-1]["run"] if now else None) != manifest["after"]:
            raise RuntimeError("another run was committed meanwhile: stage this one again")
        manifest = manifest | {"loaded_at": datetime.datetime.now(datetime.timezone.utc).isoformat()}
        fs, draft = self._fs(f"{self.root}/runs/{manifest['run']}.draft")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        # the number is part of the name: of two writers only one rename succeeds
        _, final = self._fs(f"{self.root}/runs/{manifest['number']:09d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError("another run was committed meanwhile: stage this one again")

    def write(self, records: DataFrame, rejected: DataFrame) -> dict:
        """Insert clean rows whose key is absent and append the rejected ones, both or none."""
        manifest = self.stage(records, rejected, uuid.uuid4().hex)
        self.commit(manifest)
        return manifest

    def latest_run(self) -> dict | None:
        """Counts and time of the newest run, from its manifest alone."""
        named = self.manifests()
        return {k: named[-1][k] for k in ("number", "run", "loaded_at", "clean", "quarantine")} if named else None

