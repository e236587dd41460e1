"""A vector database over Spark tables: versioned rows, an encrypted inverted-file index, searches by DataFrame."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import AlreadyExists, EmptyId, InvalidConfig, NotBuilt, NotFound, NoVectors, RepeatedId, WrongDimension
from .functions import crypt
from .functions.vectors import cosine, grid, normalize
from .operators import cluster, filters, ivf, pca, pq, privacy
from .operators.provider import PlainProvider, ScoreProvider
from .operators.scan import block_scan, scorer, top_k


@dataclass
class Config:
    dimension: int
    clusters: int = 64
    top_clusters: int = 0
    strategy: str = "threshold"
    probe_threshold: float = 0.95
    gap_multiplier: float = 2.0
    replicas: int = 1
    kmeans_inits: int = 1
    decoys: int = 8
    epsilon: float = 0.0
    bernoulli: bool = False
    padding: str = "none"
    pca_dimension: int = 0
    pq_subspaces: int = 0
    score_bits: int = 0
    min_changes: int = 1
    seed: int = 42
    key: bytes = field(default_factory=crypt.new_key, repr=False)

    def checked(self) -> Config:
        """Defaults filled in, then every bound checked."""
        if self.dimension <= 0:
            raise InvalidConfig("dimension must be positive")
        if self.clusters < 2:
            raise InvalidConfig("at least 2 clusters")
        if not self.top_clusters:
            self.top_clusters = min(self.clusters, max(self.clusters // 16, 4))
        width = self.pca_dimension or self.dimension
        for bad, what in (
            (not 0 < self.top_clusters <= self.clusters, "top_clusters"),
            (not 0 <= self.probe_threshold <= 1, "probe_threshold"),
            (self.strategy not in ("threshold", "gap", "strict"), "strategy"),
            (not 0 <= self.pca_dimension < self.dimension, "pca_dimension"),
            (self.pq_subspaces and width % self.pq_subspaces, "pq_subspaces"),
            (self.padding not in ("none", "bucketed", "max"), "padding"),
            (self.replicas < 1, "replicas"),
            (self.gap_multiplier <= 0, "gap_multiplier"),
        ):
            if bad:
                raise InvalidConfig(what)
        return self


#: Presets of privacy against recall.
PRESETS = {
    "default": {},
    "high_privacy": {"decoys": 16, "epsilon": 1.0, "padding": "max", "bernoulli": True},
    "high_recall": {"replicas": 2, "top_clusters": 16, "probe_threshold": 0.9},
}


class VectorDB:
    """Tables below path: generations of rows and tombstones, and one folder for each build of the index.

    Rows are sealed when they are added: vectors and metadata lie on disk only under the key, with their id
    as authenticated data. A generation is a folder gen-N with rows, tombstones and the last batch numbers
    of streams; a build writes a new one that holds live rows alone. States: empty, buffered (rows but no
    index), ready. A folder of the index counts once its manifest, written last, is there. The key is never
    written; the manifest has its fingerprint.
    """

    VERSION = 2
    ROWS = "vec_id string, version long, ciphertext binary, metadata binary, stream string, number long"
    BLOBS = "vec_id string, version long, replica int, ciphertext binary, codes binary, bucket int"

    def __init__(self, spark: SparkSession, path: str, config: Config, progress=None, provider: ScoreProvider | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config.checked()
        self.progress = progress or (lambda phase, share: None)
        self.provider = provider or PlainProvider()
        self.built, self.index, self.pq_book, self.pca_model = 0, None, None, None
        self.generation = max(self._generations(), default=0)
        self.version = max((t.agg(F.max("version")).first()[0] or 0 for t in (self._rows, self.tombstones)), default=0)

    # Tables

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, name: str) -> bool:
        store, p = self._fs(name)
        return store.exists(p)

    def _drop(self, name: str) -> None:
        store, p = self._fs(name)
        store.delete(p, True)

    def _folders(self, start: str) -> list[str]:
        store, p = self._fs("")
        return [n for n in (f.getPath().getName() for f in store.listStatus(p)) if n.startswith(start)] if store.exists(p) else []

    def _generations(self) -> list[int]:
        return [int(n[4:]) for n in self._folders("gen-") if self._exists(f"{n}/rows/_SUCCESS")]

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self._exists(name) else self.spark.createDataFrame([], schema)

    @property
    def _rows(self) -> DataFrame:
        return self._table(f"gen-{self.generation}/rows", self.ROWS)

    @property
    def tombstones(self) -> DataFrame:
        return self._table(f"gen-{self.generation}/tombstones", "vec_id string, version long")

    @property
    def _batches(self) -> DataFrame:
        """Last number of each stream whose rows are in."""
        old = self._table(f"gen-{self.generation}/batches", "stream string, number long")
        return old.unionByName(self._rows.where("stream is not null").select("stream", "number")).groupBy("stream").agg(F.max("number").alias("number"))

    def _live(self) -> DataFrame:
        """Newest row of each id that no tombstone covers, with the newest metadata that the id was given; still sealed."""
        rows = self._rows.groupBy("vec_id").agg(
            F.max_by(F.struct("ciphertext", "stream", "number"), "version").alias("x"), F.max("version").alias("version"),
            F.max_by("metadata", F.when(F.col("metadata").isNotNull(), F.col("version"))).alias("metadata"),
        )
        dead = self.tombstones.groupBy("vec_id").agg(F.max("version").alias("dead"))
        left = rows.join(dead, "vec_id", "left").where(F.col("dead").isNull() | (F.col("dead") < F.col("version")))
        return left.select("vec_id", "version", "x.ciphertext", "metadata", "x.stream", "x.number")

    def _opened(self, rows: DataFrame) -> DataFrame:
        """vec_id, embedding, version of sealed rows; what does not decrypt under its id is left out."""
        plain = crypt.bytes_to_vector(crypt.decrypt(F.col("ciphertext"), self.config.key, F.col("vec_id")))
        return rows.select("vec_id", plain.alias("embedding"), "version").where("embedding is not null")

    def _meta(self, body: Column) -> Column:
        return crypt.decrypt(body, self.config.key, F.concat(F.lit("metadata:"), F.col("vec_id"))).cast("string")

    @property
    def vectors(self) -> DataFrame:
        """All versions of all rows, decrypted."""
        return self._opened(self._rows)

    @property
    def live(self) -> DataFrame:
        return self._opened(self._live())

    @property
    def state(self) -> str:
        return "ready" if self.index else "buffered" if self._exists(f"gen-{self.generation}/rows/_SUCCESS") else "empty"

    def _checked(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        """All rows are checked before any is written. Of rows that repeat an id the one with the largest `order` counts; without it they are refused."""
        rows = rows.withColumn("vec_id", F.col("vec_id").cast("string"))
        dims = F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != self.config.dimension)
        bad = rows.groupBy("vec_id").agg(dims.alias("dims"), F.count("*").alias("n")).agg(
            F.sum(F.when(F.coalesce(F.col("vec_id"), F.lit("")) == "", F.col("n"))).alias("ids"), F.sum("dims").alias("dims"), F.count_if(F.col("n") > 1).alias("repeated")
        ).first()
        if bad.ids:
            raise EmptyId(f"{bad.ids} rows without an id")
        if bad.dims:
            raise WrongDimension(f"{bad.dims} rows")
        if bad.repeated and order is None:
            raise RepeatedId(f"{bad.repeated} ids occur more than once")
        return filters.newest(rows, order) if bad.repeated else rows

    # Changes

    def add(self, rows: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> None:
        """rows: vec_id, embedding, optionally metadata (JSON). Sealed and appended at once; searchable if the index is built.

        batch (stream, number) is stored with the rows, so that a batch that comes again changes nothing.
        """
        rows = self._checked(rows, order)
        if batch and not self._batches.where((F.col("stream") == batch[0]) & (F.col("number") >= batch[1])).isEmpty():
            if self.index:  # the rows are in; the index may have missed them
                self._insert(self._rows.where((F.col("stream") == batch[0]) & (F.col("number") == batch[1])).join(self.blobs.select("vec_id", "version"), ["vec_id", "version"], "left_anti"))
            return
        version, c = self.version + 1, self.config
        meta = F.col("metadata").cast("string") if "metadata" in rows.columns else F.lit(None).cast("string")
        tag = batch or (None, None)
        rows = crypt.with_bytes(rows.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), meta.alias("_meta")), "embedding", "_raw")
        sealed = rows.select(
            "vec_id", F.lit(version).cast("long").alias("version"), crypt.encrypt(F.col("_raw"), c.key, F.col("vec_id")).alias("ciphertext"),
            crypt.encrypt(F.col("_meta").cast("binary"), c.key, F.concat(F.lit("metadata:"), F.col("vec_id"))).alias("metadata"),
            F.lit(tag[0]).cast("string").alias("stream"), F.lit(tag[1]).cast("long").alias("number"),
        )
        sealed.write.mode("append").parquet(f"{self.path}/gen-{self.generation}/rows")
        self.version = version
        if self.index:
            self._insert(self._rows.where(F.col("version") == version))

    def _known(self, ids: DataFrame) -> None:
        if not ids.join(self._rows.select("vec_id"), "vec_id", "left_anti").isEmpty():
            raise NotFound("unknown id")

    def delete(self, ids: DataFrame) -> None:
        """Hidden at once; an id that was never added is refused, deleting twice is not."""
        ids = ids.select(F.col("vec_id").cast("string").alias("vec_id")).distinct()
        self._known(ids)
        ids.withColumn("version", F.lit(self.version + 1).cast("long")).write.mode("append").parquet(f"{self.path}/gen-{self.generation}/tombstones")
        self.version += 1

    def update(self, rows: DataFrame) -> None:
        """A newer version takes the place of the old one, by one append after all checks; a refused update changes nothing."""
        rows = self._checked(rows)
        self._known(rows.select("vec_id"))
        self.add(rows)

    # Index

    def _reduced(self, rows: DataFrame) -> DataFrame:
        rows = self.pca_model.project(rows) if self.pca_model else rows
        return rows.withColumn("embedding", normalize(F.col("embedding")))

    def _sealed(self, rows: DataFrame) -> DataFrame:
        """Blobs of opened rows: each under the buckets of its clusters. Vectors are sealed as they came (with PCA, reduced): normalised ones in single precision would give other scores."""
        c = self.config
        rows = self._reduced(rows.withColumn("given", F.col("embedding")))
        rows = rows.withColumn("given", F.col("embedding")) if self.pca_model else rows
        near = cluster.assign(rows, self.index["centroids"], c.replicas, keep=("version", "embedding", "given")).drop("dist")
        if c.pq_subspaces:
            near = crypt.with_bytes(pq.encode(near, self.pq_book, keep=("version", "replica", "cluster_id", "given")), "codes", "codes", "<u2")
        near = crypt.with_bytes(near.withColumn("given", F.col("given").cast("array<float>")), "given", "_raw")
        seal = lambda x: crypt.encrypt(F.col(x), c.key, F.col("vec_id"))
        codes = seal("codes") if c.pq_subspaces else F.lit(None).cast("binary")
        placed = privacy.to_storage(near, self.index["permutation"])
        return placed.select("vec_id", "version", F.col("replica").cast("int").alias("replica"), seal("_raw").alias("ciphertext"), codes.alias("codes"), F.col("bucket").cast("int").alias("bucket"))

    def _append(self, blobs: DataFrame) -> None:
        blobs.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.index['folder']}/blobs")
        self._pad()

    def _pad(self) -> None:
        """Append random rows among the blobs that bring each bucket to its padded size; both look alike."""
        c, place = self.config, f"{self.index['folder']}/blobs"
        if c.padding == "none":
            return
        counts = self.blobs.groupBy("bucket").agg(F.count("*").alias("n"))
        noise = privacy.padding(counts, c.pca_dimension or c.dimension, c.padding)
        codes = crypt.random_codes(c.pq_subspaces) if c.pq_subspaces else F.lit(None).cast("binary")
        version = (F.pmod(F.xxhash64("blob_id"), F.lit(max(1, self.version))) + 1).cast("long")
        noise.select(F.col("blob_id").alias("vec_id"), version.alias("version"), F.lit(0).alias("replica"), "ciphertext", codes.alias("codes"), "bucket").write.mode("append").partitionBy("bucket").parquet(place)

    def build(self) -> None:
        """Index all live rows anew: compact, reduce, fit centroids, permute buckets, encrypt, pad; the manifest comes last.

        Compaction writes a generation without dead rows, replaced versions and metadata of deleted ids. The one
        before stays until the next build, for results that are still being read.
        """
        if self.state == "empty":
            raise NoVectors("nothing to build")
        c, new = self.config, self.version
        if self._live().isEmpty():
            raise NoVectors("all rows are deleted")
        if new != self.generation:
            self._live().write.mode("overwrite").parquet(f"{self.path}/gen-{new}/rows-new")
            self._batches.write.mode("overwrite").parquet(f"{self.path}/gen-{new}/batches")
            store, source = self._fs(f"gen-{new}/rows-new")
            store.rename(source, self._fs(f"gen-{new}/rows")[1])
        rows = self._opened(self._table(f"gen-{new}/rows", self.ROWS))
        before = self.pq_book, self.pca_model, self.index
        try:
            self._build(rows)
        except BaseException:
            self.pq_book, self.pca_model, self.index = before
            if new != self.generation:
                self._drop(f"gen-{new}")
            raise
        old, self.generation, self.built = self.generation, new, new
        for g in self._generations():
            if g not in (old, new):
                self._drop(f"gen-{g}")
        keep = {x["folder"].rpartition("/")[2] for x in (before[2], self.index) if x}
        for folder in set(self._folders("index-")) - keep:
            self._drop(folder)
        self.progress("done", 1.0)

    def _build(self, rows: DataFrame) -> None:
        c = self.config
        if c.pca_dimension:
            self.progress("pca", 0.0)
            self.pca_model = pca.fit(rows, c.pca_dimension)
        given, rows = rows, self._reduced(rows)
        folder = f"{self.path}/index-{self.version}-{uuid.uuid4().hex[:8]}"
        if c.pq_subspaces:
            self.progress("pq_training", 0.1)
            pq.train(rows, c.pq_subspaces).write.parquet(f"{folder}/codebook")
            self.pq_book = self.spark.read.parquet(f"{folder}/codebook")
        self.progress("clustering", 0.3)
        centroids, _ = cluster.fit_kmeans(rows, c.clusters, c.seed, inits=c.kmeans_inits)
        pi = privacy.permutation(centroids, c.seed)
        pi.write.parquet(f"{folder}/permutation")
        pi = self.spark.read.parquet(f"{folder}/permutation")
        self.index = {"folder": folder, "centroids": cluster.held(centroids), "permutation": pi}
        self.progress("encrypting", 0.6)
        self._sealed(given).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/blobs")
        self.progress("indexing", 0.9)
        sizes = pi.join(self.blobs.groupBy("bucket").count(), "bucket")
        centroids.join(sizes, "cluster_id", "left").select("cluster_id", F.coalesce("count", F.lit(0)).alias("n"), "centroid").write.parquet(f"{folder}/centroids-0")
        self._pad()
        self.built = self.version
        self._manifest(folder, 0)
        self._open(folder, 0)

    rebuild = build

    def _manifest(self, folder: str, round_: int) -> None:
        config = {k: v for k, v in asdict(self.config).items() if k != "key"}
        text = {"format": self.VERSION, "version": self.version, "built": self.built, "round": round_, "config": config, "key": crypt.fingerprint(self.config.key)}
        if self.pca_model:
            text["pca"] = [self.pca_model.mean, self.pca_model.components, self.pca_model.variance]
        self.spark.createDataFrame([(json.dumps(text),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")

    def _open(self, folder: str, round_: int) -> None:
        table = lambda n: self.spark.read.parquet(f"{folder}/{n}")
        self.index = {"folder": folder, "round": round_, "centroids": cluster.held(table(f"centroids-{round_}")), "permutation": table("permutation")}

    @property
    def blobs(self) -> DataFrame:
        return self.spark.read.schema(self.BLOBS).parquet(f"{self.index['folder']}/blobs")

    def _insert(self, sealed: DataFrame) -> None:
        """Assign, permute, encrypt and append new rows, then move the centroids of their first clusters."""
        rows = self._opened(sealed)
        folder, round_ = self.index["folder"], self.index["round"]
        self._append(self._sealed(rows))
        first = cluster.assign(self._reduced(rows), self.index["centroids"], keep=("embedding",)).select("cluster_id", "embedding")
        cluster.running_mean(self.index["centroids"], first).write.mode("overwrite").parquet(f"{folder}/centroids-{round_ + 1}")
        self._manifest(folder, round_ + 1)
        self._open(folder, round_ + 1)

    def maintain(self) -> bool:
        """Build or rebuild if enough has changed since the last time; whether it did."""
        if self.state == "empty" or self.version - self.built < self.config.min_changes:
            return False
        self.build()
        return True

    # Searches

    def _visible(self, blobs: DataFrame) -> DataFrame:
        """Blobs without those that a change since the build has hidden: only changed ids are looked at, not all rows."""
        dead = self.tombstones.groupBy("vec_id").agg(F.max("version").alias("dead"))
        newer = self._rows.where(F.col("version") > self.built).groupBy("vec_id").agg(F.max("version").alias("newer"))
        hidden = dead.join(newer, "vec_id", "full").withColumnRenamed("vec_id", "_id")
        covered = (F.coalesce("dead", F.lit(-1)) >= F.col("version")) | (F.coalesce("newer", F.lit(-1)) > F.col("version"))
        return blobs.join(hidden, (F.col("vec_id") == F.col("_id")) & covered, "left_anti")

    def _asked(self, q: DataFrame) -> DataFrame:
        """query_id, bucket and whether it is probed (real) or a decoy."""
        c = self.config
        ranked = self.provider.scores(q, self.index["centroids"])
        probed = ivf.probes(q, self.index["centroids"], c.top_clusters, min(c.clusters, 2 * c.top_clusters), c.strategy, c.probe_threshold, c.gap_multiplier, ranked)
        return privacy.to_storage(self._with_decoys(probed), self.index["permutation"]).select("query_id", "bucket", "real")

    def _fetched(self, asked: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        """Rows of all asked buckets, decoys among them, in folders pruned by bucket."""
        return asked.join(self.blobs.select("bucket", *columns), "bucket")

    @staticmethod
    def _only_real(fetched: DataFrame) -> DataFrame:
        """Drop what decoys brought. The condition needs the fetched row, so it can't be decided before the fetch."""
        return fetched.where(F.when(F.col("vec_id").isNotNull(), F.col("real")))

    def reads(self, queries: DataFrame) -> DataFrame:
        """query_id, real, buckets, blobs: what a search fetches from probed buckets and from decoys."""
        asked = self._asked(self._reduced(queries.select("query_id", "embedding")))
        return self._fetched(asked, ("vec_id",)).groupBy("query_id", "real").agg(F.countDistinct("bucket").alias("buckets"), F.count("*").alias("blobs"))

    def search(self, queries: DataFrame, k: int = 10, hidden_after: bool = False) -> DataFrame:
        """query_id, vec_id, score, rank for queries (query_id, embedding).

        Deleted and replaced rows leave before the best k are taken, or after it (then there may be fewer than k).
        """
        if self.state == "empty":
            raise NoVectors("no vectors")
        if self.state != "ready":
            raise NotBuilt("build first")
        if k <= 0:
            raise ValueError("k must be positive")
        q = self._query(queries)
        asked = self._asked(q)
        places = asked.groupBy("bucket").agg(F.bool_or("real").alias("real"))
        stored = self._only_real(self._fetched(places, ("vec_id", "version", "ciphertext", "codes")))
        if not hidden_after:
            stored = self._visible(stored)
        found = self._scored(stored, q, k, asked.where("real").select("query_id", "bucket"))
        return (self._visible(found) if hidden_after else found).select("query_id", "vec_id", "score", "rank")

    def _query(self, queries: DataFrame) -> DataFrame:
        if not queries.where(F.coalesce(F.size("embedding"), F.lit(-1)) != self.config.dimension).isEmpty():
            raise WrongDimension("query")
        return self._reduced(queries.select("query_id", "embedding"))

    def _scored(self, stored: DataFrame, q: DataFrame, k: int, probed: DataFrame | None = None) -> DataFrame:
        """The best k of stored rows (bucket, vec_id, version, ciphertext, codes) by exact scores.

        probed: query_id and bucket; without it every query meets every row. A row is decrypted before it meets
        queries, once for all of them, and meets them as matrices; with codes only pairs of the short list are decrypted.
        """
        c = self.config
        opened = lambda rows: rows.withColumn("v", crypt.bytes_to_vector(crypt.decrypt(F.col("ciphertext"), c.key, F.col("vec_id")))).where("v is not null").select("bucket", "vec_id", "version", "v", *(["query_id"] if "query_id" in rows.columns else []))
        if not c.pq_subspaces:
            rows = opened(stored).withColumnRenamed("v", "embedding")
            return block_scan(q, rows, "embedding", scorer(bits=c.score_bits), k, "score", False, T.DoubleType(), probed, "bucket", ("version",), c.replicas)
        met = lambda rows: rows.join(q.select("query_id")) if probed is None else rows.join(probed, "bucket")
        codes = stored.select("bucket", "vec_id", crypt.bytes_to_codes(crypt.decrypt(F.col("codes"), c.key, F.col("vec_id"))).alias("codes")).where("codes is not null")
        codes = met(codes).select("query_id", "vec_id", "codes").dropDuplicates(["query_id", "vec_id"])
        near = pq.adc_scores(pq.distance_tables(q, self.pq_book), codes, codes.select("query_id", "vec_id"))
        plain = opened(met(stored).join(pq.shortlist(near, k).select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi"))
        score = cosine(F.col("embedding"), F.col("v"))
        score = grid(score, c.score_bits) if c.score_bits else F.round(score, 6)
        best = plain.join(q, "query_id").select("query_id", "vec_id", "version", score.alias("score"))
        if c.replicas > 1:
            best = top_k(best, k * c.replicas).drop("rank").distinct()
        return top_k(best, k)

    def _with_decoys(self, probed: DataFrame) -> DataFrame:
        c = self.config
        count = privacy.decoy_count(c.epsilon, c.clusters, c.top_clusters) if c.epsilon > 0 else min(c.decoys, c.clusters - c.top_clusters)
        pick = privacy.bernoulli_decoys if c.bernoulli else privacy.uniform_decoys
        return probed.withColumn("real", F.lit(True)).unionByName(pick(probed, self.index["centroids"], count, c.seed).withColumn("real", F.lit(False)))

    def search_where(self, queries: DataFrame, where: dict, k: int = 10, before: bool = False) -> DataFrame:
        """Results whose metadata match: k after over-fetching, or exactly from all matching rows (before).

        before reads no bucket by its place: all blobs of matching ids are scored, whatever their cluster, so a rare
        filter finds all there is.
        """
        meta = self.metadata_table()
        if not before:
            return filters.filtered_after(self.search(queries, max(3 * k, 50)), meta, where, k)
        q = self._query(queries)
        ids = meta.where(filters.matches(F.col("metadata"), where)).select("vec_id")
        stored = self._visible(self.blobs.where("replica = 0").join(ids, "vec_id", "left_semi"))
        return self._scored(stored, q, k).select("query_id", "vec_id", "score", "rank")

    # Look-ups

    def get(self, vec_id: str) -> list[float]:
        """The stored vector, decrypted, normalised and perhaps reduced."""
        if not self.index:
            raise NotBuilt("build first")
        rows = self._visible(self.blobs.where((F.col("vec_id") == str(vec_id)) & (F.col("replica") == 0)))
        found = self._opened(rows).orderBy(F.desc("version")).select(normalize(F.col("embedding")).alias("embedding")).take(1)
        if not found:
            raise NotFound(vec_id)
        return list(found[0].embedding)

    def _live_ids(self) -> DataFrame:
        return self._live().select("vec_id")

    def has(self, vec_id: str) -> bool:
        return not self._live_ids().where(F.col("vec_id") == str(vec_id)).isEmpty()

    def metadata_table(self) -> DataFrame:
        """vec_id and metadata (JSON) of live rows, decrypted."""
        return self._live().select("vec_id", self._meta(F.col("metadata")).alias("metadata"))

    def metadata(self, vec_id: str) -> dict | None:
        rows = self.metadata_table().where(F.col("vec_id") == str(vec_id)).take(1)
        if not rows:
            raise NotFound(vec_id)
        return json.loads(rows[0].metadata) if rows[0].metadata else None

    def list(self, offset: int = 0, limit: int = 100) -> DataFrame:
        return filters.page(self._live_ids(), offset, limit)

    def count(self) -> int:
        return self._live_ids().count()

    def stats(self) -> dict:
        out = {"state": self.state, "vectors": self.count() if self.state != "empty" else 0, "dimension": self.config.dimension, "version": self.version, "changes": self.version - self.built}
        return out | ({"blobs": self._own_blobs().count(), "clusters": self.config.clusters} if self.index else {})

    def _own_blobs(self) -> DataFrame:
        """Blobs of live rows, without padding and hidden versions."""
        return self.blobs.join(self._live().select("vec_id", "version"), ["vec_id", "version"], "left_semi")

    def cluster_stats(self) -> dict:
        current = self._own_blobs().where("replica = 0").join(self.index["permutation"], "bucket")
        return cluster.size_statistics(cluster.cluster_sizes(current, self.index["centroids"])).first().asDict()

    # Copies

    def save(self, path: str) -> None:
        """Copy of all tables and of the index; the manifest is written last and marks it complete. A failed copy is taken away."""
        if not self.index:
            raise NotBuilt("build first")
        other = VectorDB(self.spark, path, self.config)
        if other._exists("manifest"):
            raise AlreadyExists(path)
        fresh = not other._exists("")
        copy = lambda source, target: self.spark.read.parquet(source).write.parquet(target)
        try:
            for name in ("rows", "tombstones", "batches"):
                if self._exists(f"gen-{self.generation}/{name}"):
                    copy(f"{self.path}/gen-{self.generation}/{name}", f"{path}/gen-{self.generation}/{name}")
            source, target = self.index["folder"], f"{path}/index"
            self.blobs.write.partitionBy("bucket").parquet(f"{target}/blobs")
            for name in ("permutation", "codebook"):
                if self._exists(f"{source.rpartition('/')[2]}/{name}"):
                    copy(f"{source}/{name}", f"{target}/{name}")
            self.index["centroids"].write.parquet(f"{target}/centroids-0")
            self._manifest(path, 0)
        except BaseException:
            if fresh:
                other._drop("")
            raise

    @classmethod
    def load(cls, spark: SparkSession, path: str, key: bytes, provider: ScoreProvider | None = None) -> VectorDB:
        text = json.loads("".join(r.value for r in spark.read.text(f"{path.rstrip('/')}/manifest").collect()))
        if text["format"] != cls.VERSION:
            raise InvalidConfig(f"format {text['format']}")
        if text["key"] != crypt.fingerprint(key):
            raise InvalidConfig("another key")
        db = cls(spark, path, Config(**text["config"], key=key), provider=provider)
        db.version, db.built = max(db.version, text["version"]), text["built"]
        if "pca" in text:
            db.pca_model = pca.Components(*text["pca"])
        db._open(f"{db.path}/index", 0)
        if db.config.pq_subspaces:
            db.pq_book = spark.read.parquet(f"{db.path}/index/codebook")
        return db

    def close(self) -> None:
        self.index = None
