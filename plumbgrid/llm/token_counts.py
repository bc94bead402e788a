"""Token counts as a delta-maintained rollup.

A ledger holds three kinds of Parquet tables in a shared folder: the current count of every document and tokenizer
version (state), the signed changes of each batch to the totals (delta), and the totals by source, language and version.
A batch is compared with the state it meets: an insert adds a document, a delete takes back what the state holds, a
revision takes back the old count and adds the new one, wherever source and language have gone meanwhile.  Totals are
the previous totals plus the delta, so a batch costs its own rows and the state rows they meet, not a recount.

A commit is published by one small manifest that is created last and at once; what a lost driver leaves behind is
unreferenced and overwritten by the next try.  Batches are known by name: one that the manifest lists is not applied
again.  The state is split by document hash into ``parts`` folders, as many as the first batch asks for; a batch rewrites
only the parts that it touches, each in files of bounded size.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_PARTS, PART_ROWS, FILE_BYTES = 16, 2_000_000, 64 << 20
KEY = ["doc_id", "version"]
GROUP = ["source", "lang", "version"]
STATE = "doc_id long, version string, source string, lang string, n_tokens long"
TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"


class TokenLedger:
    """Rollup of token counts under ``path``, a folder that the cluster shares; one writer at a time.

    ``parts`` is fixed by the first batch that is not empty: as given, else by its number of rows.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int | None = None) -> None:
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    # small files by Hadoop's file system, so that any store that Spark writes will do
    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _manifest(self) -> dict:
        fs, folder = self._fs("manifest")
        if not fs.exists(folder):
            return {"version": 0, "batches": [], "state": {}, "totals": None}
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        if not names:
            return {"version": 0, "batches": [], "state": {}, "totals": None}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{names[-1]}", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        fs, final = self._fs(f"manifest/{manifest['version']:012d}.json")
        _, draft = self._fs(f"manifest/{manifest['version']:012d}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(draft, final):
            raise RuntimeError(f"another writer has published version {manifest['version']}")

    def batches(self) -> list[str]:
        return self._manifest()["batches"]

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def totals(self) -> DataFrame:
        """``source, lang, version, n_docs, n_tokens`` after the last commit; groups without documents are left out."""
        m = self._manifest()
        return self._read([m["totals"]] if m["totals"] else [], TOTALS)

    def state(self) -> DataFrame:
        return self._read(sorted(self._manifest()["state"].values()), STATE)

    @staticmethod
    def _part(parts: int):
        return F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes(doc_id, version, seq, op, source, lang, n_tokens)``; False if the batch is known already.

        ``op`` is ``insert``, ``delete`` or ``revise``.  Of several changes to one document and version the one with the
        largest ``seq`` counts (ties: delete before revise before insert, then the largest count).  An insert of a known
        document replaces its count; a revision of an unknown or deleted one, a delete of an unknown one, rows without
        document or version and rows of any other ``op`` change nothing.  Null counts are zero; null sources and
        languages are groups of their own, but a revision that has both null keeps those of the state.  An empty batch
        is recorded.  Other columns are ignored.
        """
        m = self._manifest()
        if batch in m["batches"]:
            return False
        number = m["version"] + 1
        rank = F.when(F.col("op") == "delete", 3).when(F.col("op") == "revise", 2).when(F.col("op") == "insert", 1)
        c = changes.select(F.col("doc_id").cast("long").alias("doc_id"), "version", "seq", "op", "source", "lang", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        c = c.where(rank.isNotNull() & F.col("doc_id").isNotNull() & F.col("version").isNotNull())
        last = c.groupBy(*KEY).agg(F.max(F.struct("seq", rank.alias("rank"), "n_tokens", "source", "lang")).alias("c"))
        parts = m.get("parts") or self.parts or max(LEAST_PARTS, -(-changes.count() // PART_ROWS))
        last = last.withColumn("part", self._part(parts))
        last.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/batch/{number}")
        last = self.spark.read.parquet(f"{self.path}/batch/{number}") if last.take(1) else last
        touched = sorted(r[0] for r in last.select("part").distinct().collect())  # as many as there are parts at most
        old = self._read(sorted({m["state"][str(p)] for p in touched if str(p) in m["state"]}), STATE)
        old = old.select(*KEY, F.struct("source", "lang", "n_tokens").alias("old"))
        j = old.join(last.select(*KEY, "c"), KEY, "full")
        stays = F.struct("old.source", "old.lang", "old.n_tokens")
        kept = F.col("c.source").isNull() & F.col("c.lang").isNull()
        revised = F.struct(
            F.when(kept, F.col("old.source")).otherwise(F.col("c.source")).alias("source"),
            F.when(kept, F.col("old.lang")).otherwise(F.col("c.lang")).alias("lang"),
            F.col("c.n_tokens").alias("n_tokens"),
        )
        new = (
            F.when(F.col("c").isNull(), stays)
            .when(F.col("c.rank") == 1, F.struct("c.source", "c.lang", "c.n_tokens"))
            .when((F.col("c.rank") == 2) & F.col("old").isNotNull(), revised)
        )
        j = j.select(*KEY, "old", new.alias("new"), F.col("c").isNotNull().alias("hit"))
        j.write.mode("overwrite").parquet(f"{self.path}/merged/{number}")
        j = self.spark.read.schema(j.schema).parquet(f"{self.path}/merged/{number}")
        state = j.where("new is not null").select(*KEY, "new.source", "new.lang", "new.n_tokens").withColumn("part", self._part(parts))
        fs, merged = self._fs(f"merged/{number}")
        files = max(1, -(-int(fs.getContentSummary(merged).getLength()) // (max(1, len(touched)) * FILE_BYTES)))
        state = state.withColumn("file", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(files))).repartition(max(1, len(touched)) * files, "part", "file").drop("file")
        state.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/state/{number}")
        signed = lambda c, sign: j.where(f"hit and {c} is not null").select("version", f"{c}.source", f"{c}.lang", F.lit(sign).cast("long").alias("n_docs"), (F.col(f"{c}.n_tokens") * sign).alias("n_tokens"))
        delta = signed("old", -1).unionByName(signed("new", 1)).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        delta.select(*GROUP, "n_docs", "n_tokens").write.mode("overwrite").parquet(f"{self.path}/delta/{number}")
        before = self._read([m["totals"]] if m["totals"] else [], TOTALS)
        after = before.unionByName(self._read([f"delta/{number}"], TOTALS)).groupBy(*GROUP)
        after = after.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0")
        after.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/{number}")
        fs, _ = self._fs("state")
        placed = dict(m["state"])
        for p in touched:
            own = f"state/{number}/part={p}"
            placed.pop(str(p), None)
            if fs.exists(self._fs(own)[1]):
                placed[str(p)] = own
        self._publish({"version": number, "batches": [*m["batches"], batch], "state": placed, "totals": f"totals/{number}", "parts": parts if touched else m.get("parts")})
        for folder in (f"merged/{number}", f"batch/{number}"):
            fs.delete(self._fs(folder)[1], True)
        return True
