"""One ingest run as a job: a stream of chunks into archive, chunks, catalog and cursor, each batch committed whole or not at all.

A collection is a folder of Parquet tables and of commits. A batch writes its
part of each table under its own (run, batch) folder and then creates one
commit file, which must not exist: readers see what commits name and nothing
else. A batch that was killed leaves no commit, and its next attempt
overwrites what it wrote; one that is repeated finds its commit and does
nothing.

A run knows what was in the collection when it began (and, if asked, what
donors know), so its result does not depend on how its stream was cut into
batches, or where it was killed and resumed: repeats within a run stay. The
catalog is merged once, by ``finish``, from all that the run's batches saw.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, MapType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..operators import chunking, ingest, upkeep
from ..operators.store import Conflict
from ..session import checkpointed, sized

_TEXTS, _PAIRS = ArrayType(StringType()), MapType(StringType(), StringType())


def _schema(texts: str, **others: DataType) -> StructType:
    return StructType([StructField(n, StringType()) for n in texts.split()] + [StructField(n, t) for n, t in others.items()])


#: What an adapter emits. ``ord`` is a chunk's place in its source; ``raw`` is the document's content, which is archived and not kept in chunks.
CHUNK = _schema("id document_id version source_type source path content raw fingerprint ts updated_at created_at", metadata=_PAIRS, ord=LongType())
ARCHIVE = _schema("document_id version source_key source_type checksum content", metadata=_PAIRS, bytes=LongType())
STORED = _schema("id parent_id document_id version source_type source path content fingerprint ts", metadata=_PAIRS, ord=LongType(), piece=IntegerType())
SEEN = _schema("document_id version id fingerprint source_type", ord=LongType(), piece=IntegerType())
KNOWN = _schema("id fingerprint")
CATALOG = _schema("document_id version state mutability", chunk_ids=_TEXTS, previous=_TEXTS, superseded=_TEXTS)
TABLES = {"archive": ARCHIVE, "chunks": STORED, "seen": SEEN, "known": KNOWN, "catalog": CATALOG}


class IngestJob:
    """A run of a collection. The same ``run`` name resumes a run that has not finished; another name while one is open is a Conflict."""

    def __init__(self, spark: SparkSession, folder: str, run: str, source_key: str, document_ids: list[str] | None = None, paths: list[str] | None = None, since: str | None = None, most: int = 4000, append_only: tuple[str, ...] = ()):
        self.spark, self.folder, self.run, self.source_key = spark, folder.rstrip("/"), run, source_key
        self.filters, self.most, self.append_only = {"ids": document_ids, "paths": paths, "since": since}, most, append_only
        self.partial = any(self.filters.values())
        opened, done = self._names("opened"), self._names("done")
        if opened and opened[-1] not in done:
            self.number = int(opened[-1])
            if self._read(f"opened/{opened[-1]}.json")["run"] != run:
                raise Conflict(f"run {self._read(f'opened/{opened[-1]}.json')['run']} is open")
        else:
            self.number = len(opened) + 1
            self._create(f"opened/{self.number:06d}.json", {"run": run})

    # -- files -------------------------------------------------------------

    def _path(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        """The sorted names of a folder's files: one a run or batch, not data."""
        files, at = self._path(folder)
        names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        return sorted(n.removesuffix(".json") for n in names if n.endswith(".json"))

    def _create(self, name: str, body: dict) -> None:
        """A new file; of two writers one fails. It appears under its name once it is whole."""
        files, at = self._path(name)
        parts = self._path(f"{name}.{self.run}.tmp")[1]
        try:
            out = files.create(parts, True)
            out.write(bytearray(json.dumps(body).encode()))
            out.close()
            if files.exists(at) or not files.rename(parts, at):
                files.delete(parts, False)
                raise Conflict(f"{name} exists")
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"{name} exists") from e
            raise

    def _read(self, name: str) -> dict:
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.folder}/{name}").collect()))  # one small file

    # -- tables ------------------------------------------------------------

    def _commits(self, own: bool | None = None) -> list[str]:
        return [n for n in self._names("commits") if own is None or n.startswith(f"{self.number:06d}-") == own]

    def table(self, name: str, own: bool | None = None) -> DataFrame:
        """The committed rows of a table: of all runs, of this one only (``own``), or of the others. Of the catalog the last run's."""
        of = {"catalog": lambda kind: kind == "end", "known": lambda kind: kind == "donors", "archive": lambda kind: kind != "end"}.get(name, str.isdigit)
        commits = [c for c in self._commits(own) if of(c.partition("-")[2])]
        if name == "catalog":
            commits = commits[-1:]
        if not commits:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(f"{self.folder}/{name}/{c}" for c in commits))

    def _write(self, rows: DataFrame, name: str, commit: str) -> None:
        rows.select([F.col(f.name).cast(f.dataType) for f in TABLES[name].fields]).write.mode("overwrite").parquet(f"{self.folder}/{name}/{commit}")

    def commit(self, name: str, body: dict) -> None:
        self._create(f"commits/{name}.json", body)

    # -- stages ------------------------------------------------------------

    def reuse_donors(self, archives: DataFrame, catalogs: DataFrame | None = None) -> list[str]:
        """Archive what other collections have of this source: ``archives`` has collection, storage_id and the columns of the archive. Returns their names.

        With ``catalogs`` (collection, document_id, chunk_ids, fingerprints) the
        chunks of the documents replayed count as known in this run. A partial
        run reuses nothing.
        """
        name = f"{self.number:06d}-donors"
        if self.partial or name in self._commits():
            return []
        mine = F.lit(self.folder)
        matches = upkeep.donors(archives, mine, F.lit(self.source_key))
        found = archives.where(F.col("source_key") == self.source_key).join(matches.select("collection"), "collection", "left_semi").where(F.coalesce("storage_id", F.lit("")) != "")
        self._archive(found.select("document_id", "version", "source_type", "metadata", F.col("content").alias("raw")), name)
        known = self.spark.createDataFrame([], KNOWN)
        if catalogs is not None:
            docs = catalogs.join(found.select("collection", "document_id").distinct(), ["collection", "document_id"], "left_semi")
            ids = docs.select(F.explode("chunk_ids").alias("id"), F.lit(None).cast("string").alias("fingerprint"))
            known = ids.unionByName(docs.select(F.lit(None).cast("string").alias("id"), F.explode("fingerprints").alias("fingerprint")))
        self._write(known, "known", name)
        names = [r["collection"] for r in matches.orderBy("collection").collect()]  # collections, not data
        self.commit(name, {"reused": found.count(), "collections": names})
        return names

    def _archive(self, rows: DataFrame, commit: str) -> None:
        """Raw contents of (document, version) that no committed batch has; of several within the rows the first."""
        key = ["document_id", "version"]
        rows = rows.where(F.col("raw").isNotNull() & (F.col("raw") != "") & F.col("document_id").isNotNull() & F.col("version").isNotNull())
        order = F.col("ord") if "ord" in rows.columns else F.sha2("raw", 256)
        keys = checkpointed(rows.select(*key))  # contents stay where they are
        held = checkpointed(keys.distinct().join(self.table("archive").select(*key), key, "left_semi"))
        several = checkpointed(keys.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key))
        rows, x = rows.join(sized(held), key, "left_anti"), F.struct("source_type", "metadata", "raw")
        new = rows.join(sized(several), key, "left_anti").select(*key, x.alias("x"))
        new = new.unionByName(rows.join(sized(several), key, "left_semi").groupBy(*key).agg(F.min_by(x, order).alias("x")))
        self._write(new.select(*key, F.lit(self.source_key).alias("source_key"), "x.source_type", upkeep.archived_metadata(F.col("x.metadata")).alias("metadata"), F.sha2("x.raw", 256).alias("checksum"), F.octet_length("x.raw").alias("bytes"), F.col("x.raw").alias("content")), "archive", commit)

    def step(self, batch: DataFrame, number: int) -> None:
        """A micro-batch: archive, filter, cut, remember for the catalog, deduplicate, store, commit."""
        name = f"{self.number:06d}-{number:09d}"
        if name in self._commits():
            return
        rows = batch.select([F.col(f.name).cast(f.dataType) if f.name in batch.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CHUNK.fields]).persist()
        try:
            self._archive(rows, name)
            kept = chunking.rechunked(ingest.document_filter(rows, **self.filters).drop("raw"), self.most)
            documents = kept.where("document_id is not null and version is not null")
            self._write(documents, "seen", name)
            earlier = [self.table(t, own=False).select("id", "fingerprint") for t in ("seen", "chunks")]
            known = earlier[0].unionByName(earlier[1]).unionByName(self.table("known", own=True))
            fresh = ingest.unseen(kept, known.where("id is not null"), known.where("fingerprint is not null"))
            self._write(fresh, "chunks", name)
            newest = rows.agg(F.max(F.coalesce("ts", "updated_at", "created_at", F.lit(""))).alias("t"), F.count("*").alias("n")).first()
            self.commit(name, {"newest": newest["t"] or "", "rows": newest["n"]})
        finally:
            rows.unpersist()

    def stream(self, rows: DataFrame, checkpoint: str | None = None) -> StreamingQuery:
        """All that is available through ``step``; start it again after a failure and it goes on where it stopped."""
        at = checkpoint or f"{self.folder}/progress/{self.number:06d}"
        return rows.writeStream.foreachBatch(self.step).option("checkpointLocation", at).trigger(availableNow=True).start()

    def finish(self, renames: DataFrame | None = None, commit_sha: str | None = None) -> dict:
        """Merge the run into the catalog, archive the documents of ``renames`` (document_id: the old ones), set the cursor, close the run.

        A partial run archives no renamed ones and moves no cursor.
        """
        name = f"{self.number:06d}-end"
        if name not in self._commits():
            before = self.table("catalog")
            every = self.table("seen", own=True)
            first = F.min_by(F.struct("version", "source_type"), F.struct("ord", "piece"))
            docs = every.groupBy("document_id").agg(first.alias("x"), F.array_sort(F.collect_list(F.struct("ord", "piece", "id"))).alias("c"))
            gone = F.col("x.source_type") == "tombstone"
            incoming = docs.select("document_id", F.col("x.version").alias("version"), F.col("c.id").alias("chunk_ids"), F.when(F.col("x.source_type").isin(*self.append_only), "append-only").otherwise("mutable-state").alias("mutability"), gone.alias("tombstone"))
            incoming = incoming.where("not tombstone").unionByName(incoming.where("tombstone").join(before, "document_id", "left_semi"))
            after = ingest.catalog_upsert(before, incoming)
            if renames is not None and not self.partial:
                old = renames.select("document_id").distinct().withColumn("_old", F.lit(True))
                after = after.join(old, "document_id", "left").withColumn("state", F.when(F.col("_old"), "archived").otherwise(F.col("state"))).drop("_old")
            self._write(after, "catalog", name)
            newest = self.spark.read.schema("newest string").json([f"{self.folder}/commits/{c}.json" for c in self._commits(own=True)]).agg(F.max("newest")).first()[0] if self._commits(own=True) else ""
            earlier = self._read(f"done/{self.number - 1:06d}.json")["next"] if self.number > 1 else None
            cursor = None if self.partial else commit_sha or (max(newest or "", earlier or "") or None)
            self.commit(name, {"newest": newest, "cursor": cursor, "next": cursor or earlier})
        body = self._read(f"commits/{name}.json")
        if f"{self.number:06d}" not in self._names("done"):
            self._create(f"done/{self.number:06d}.json", body)
        return body


def searchable(job: IngestJob) -> DataFrame:
    """The stored chunks without those of archived documents and superseded ones; of a chunk stored by several runs or twice in one, the first."""
    once = Window.partitionBy("id").orderBy("ord", "document_id", "version")
    rows = job.table("chunks").withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r")
    return ingest.excluded(rows, job.table("catalog").withColumnRenamed("superseded", "superseded_chunk_ids"))
