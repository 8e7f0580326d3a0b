"""A code base's tables from end to end: index, query, update."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions.ordering import written
from sparkwright.operators import context, dense, fuse, graph, parse, requests, sparse
from sparkwright.sources.buckets import Buckets
from sparkwright.sources.store import Store, changed_files

#: Tables in buckets by file: an update of a file rewrites its bucket of each.
BY_FILE = {
    "cache": "file_path string, fingerprint string, file_size_bytes bigint, last_updated string",
    "chunks": parse.CHUNKS,
    "postings": "doc_id string, term string, tf bigint, len bigint, file_path string",
    "vectors": "file_path string, doc_id string, vec array<double>",
}


class Tables(Store):
    """A store some of whose tables are in buckets by file_path."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        super().__init__(spark, folder)
        self.by_file = {name: Buckets(spark, f"{self.folder}/{name}", schema, ["file_path"], buckets) for name, schema in BY_FILE.items()}

    def exists(self, name: str) -> bool:
        if name not in self.by_file:
            return super().exists(name)
        fs, p = self._fs(f"{self.folder}/{name}")
        return fs.exists(p)

    def read(self, name: str) -> DataFrame | None:
        if name not in self.by_file:
            return super().read(name)
        return self.by_file[name].read() if self.exists(name) else None


class Engine:
    """Tables: cache(file_path, fingerprint, file_size_bytes, last_updated), chunks, postings, vectors, edges, nodes."""

    def __init__(self, spark: SparkSession, folder: str, embedder=None, scorer=context.overlap, min_chunk_lines: int = 5):
        self.spark, self.store = spark, Tables(spark, folder)
        self.embed, self.scorer, self.min_lines = embedder or dense.hashed_embedder(), scorer, min_chunk_lines

    def index(self, files: DataFrame) -> dict:
        """files(file, text): only those whose content changed are chunked; the rest stays in all tables."""
        new = files.where("text is not null").select(F.col("file").alias("file_path"), "text", F.sha2("text", 256).alias("fingerprint"), F.length(F.encode("text", "UTF-8")).cast("bigint").alias("file_size_bytes"))
        old = self.store.read("cache")
        if old is not None:
            new = changed_files(new, old)
        new = new.withColumn("last_updated", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        new = self.store.write("changed", new, keep=1)
        made = self.store.write("new-chunks", parse.chunks(new.select(F.col("file_path").alias("file"), "text"), min_lines=self.min_lines), keep=1)
        self._replace(new.select("file_path"), made)
        self.store.by_file["cache"].upsert(new.drop("text"))
        return {"files": new.count(), "chunks": made.count(), "total_chunks": self.store.read("chunks").count()}

    def _replace(self, files: DataFrame, made: DataFrame) -> None:
        """The files' chunks, postings and vectors give way to the new ones; edges and their dirt are worked out again."""
        before = self.store.read("nodes")
        for name, rows in (("chunks", made), ("postings", self._postings(made)), ("vectors", self._vectors(made))):
            self.store.by_file[name].replace(files, rows)
        chunks = self.store.read("chunks")
        nodes = chunks.select(F.col("chunk_id").alias("node_id"), F.col("chunk_type").alias("node_type"), "file_path", "symbol_name", "fingerprint", F.lit(False).alias("is_dirty"), F.lit(None).cast("map<string,string>").alias("metadata"))
        if before is not None:
            was = before.select("node_id", F.col("fingerprint").alias("_f"), F.col("is_dirty").alias("_d"))
            changed = nodes.join(was, "node_id").where("fingerprint <> _f").select("node_id")
            dirty = graph.mark_dirty(before, self.store.read("edges"), changed)
            nodes = nodes.join(was, "node_id", "left").withColumn("is_dirty", F.coalesce("_d", F.lit(False))).drop("_f", "_d")
            nodes = graph.set_dirty(nodes, dirty)
        self.store.write("nodes", nodes)
        calls = chunks.where("chunk_type <> 'import'").select(F.col("file_path").alias("file"), F.col("symbol_name").alias("source"), F.explode(F.concat(F.transform("calls", lambda c: F.struct(F.element_at(F.split(c, r"\."), -1).alias("target"), F.lit("call").alias("type"))), F.transform("inherits", lambda c: F.struct(c.alias("target"), F.lit("inheritance").alias("type"))))).alias("r"))
        refs = calls.select("file", "source", "r.target", "r.type", F.lit(1.0).alias("weight"))
        defs = chunks.where("chunk_type <> 'import'").select(F.col("chunk_id").alias("node_id"), F.col("file_path").alias("file"), F.col("symbol_name").alias("name"), F.col("start_line").alias("ordinal"))
        found = graph.resolve(refs, defs).where("src is not null and dst is not null")
        self.store.write("edges", graph.last_edges(found.withColumn("ordinal", F.col("type")), "ordinal"))

    def _postings(self, chunks: DataFrame) -> DataFrame:
        found = sparse.terms(chunks, "chunk_id", F.col("content"))
        return found.join(chunks.select(F.col("chunk_id").alias("doc_id"), "file_path"), "doc_id")

    def _vectors(self, chunks: DataFrame) -> DataFrame:
        return chunks.select("file_path", F.col("chunk_id").alias("doc_id"), self.embed(F.col("content")).alias("vec"))

    def delete(self, files: DataFrame) -> None:
        """files(file_path): all of their rows go."""
        self._replace(files, self.store.read("chunks").limit(0))
        self.store.by_file["cache"].delete(files)

    def search(self, queries: DataFrame, k: int = 20, alpha: float = 0.5, mode: str = "hybrid") -> DataFrame:
        """queries(query_id bigint, text) -> (query_id, rank, doc_id, score); nothing before the first index().

        mode: keyword (any term, BM25), semantic (inner product), anything else weighted fusion of both.
        """
        chunks = self.store.read("chunks")
        if chunks is None:
            return self.spark.createDataFrame([], "query_id bigint, rank bigint, doc_id string, score double")
        if mode == "keyword":
            return self._keyword(queries, chunks, k)
        if mode == "semantic":
            return self._semantic(queries, k)
        return fuse.weighted_rrf(self._semantic(queries), self._keyword(queries, chunks), k, alpha)

    def _keyword(self, queries: DataFrame, chunks: DataFrame, k: int = 50) -> DataFrame:
        return sparse.okapi(self.store.read("postings"), sparse.query_terms(queries, "query_id", F.col("text")), chunks.count(), k)

    def _semantic(self, queries: DataFrame, k: int = 50) -> DataFrame:
        asked = queries.select("query_id", self.embed(F.col("text")).alias("vec"))
        return dense.inner_product_top_k(asked, self.store.read("vectors").select("doc_id", "vec"), k)

    def query(self, queries: DataFrame, k: int = 10, candidates: int = 50, depth: int = 3) -> dict[str, DataFrame]:
        """Search, rerank, expand, score: results, dependencies and completeness of each query."""
        chunks = self.store.read("chunks").select(F.col("chunk_id").alias("doc_id"), "content", "symbol_name")
        first = self.search(queries, candidates).join(chunks.select("doc_id", "content"), "doc_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        best = written(context.rerank(first, k, self.scorer), "best")
        more = written(context.expand(best.select("query_id", "doc_id"), self.store.read("edges"), depth), "dependencies")
        whole = best.join(chunks, "doc_id").select("query_id", F.col("doc_id").alias("chunk_id"), "content", "symbol_name")
        return {"results": best, "dependencies": more, "completeness": context.completeness(whole, more)}

    def answer(self, queries: DataFrame, max_tokens: int = 4096, min_completeness: float = 0.9, dependency_depth: int = 2) -> dict[str, DataFrame]:
        """The context request: five results for each step of depth, those that fit max_tokens with their contents, the completeness
        by min_completeness, and what could be added. ValueError for arguments out of their limits."""
        requests.context_request("batch", max_tokens, min_completeness, dependency_depth)
        found = self.query(queries, 5 * dependency_depth, depth=dependency_depth)
        chunks = self.store.read("chunks").select(F.col("chunk_id").alias("doc_id"), "content", "symbol_name")
        whole = found["results"].join(chunks, "doc_id", "left").withColumn("content", F.coalesce("content", F.lit("")))
        scored = context.completeness(whole.select("query_id", F.col("doc_id").alias("chunk_id"), "content", "symbol_name"), found["dependencies"], min_completeness)
        nodes = self.store.read("nodes").select("node_id", "symbol_name")
        return {"results": context.within_budget(whole, max_tokens), "dependencies": found["dependencies"], "completeness": scored, "suggestions": context.suggestions(scored, nodes)}

    def stats(self) -> DataFrame:
        """One row: files, bytes, chunks, distinct terms, vectors, nodes, dirty nodes and edges; 0 for what was never written."""
        count = lambda name, value: self.store.read(name).agg(value).first()[0] or 0 if self.store.exists(name) else 0
        every = F.count("*")
        row = (
            count("cache", every), count("cache", F.sum("file_size_bytes")), count("chunks", every), count("postings", F.countDistinct("term")),
            count("vectors", every), count("nodes", every), count("nodes", F.sum(F.col("is_dirty").cast("int"))), count("edges", every),
        )
        return self.spark.createDataFrame([row], "files bigint, bytes bigint, chunks bigint, terms bigint, vectors bigint, nodes bigint, dirty bigint, edges bigint")
