"""Raw files to chunks to collections, and their removal. Paths may lie in any file system that Spark reaches."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..config import Config, load_config
from ..functions.embed import Embedder, HashEmbedder
from ..operators import api_dim, code_chunks, doc_chunks, report
from ..operators.retriever import Retriever
from ..sources import jsonl, storage
from ..sources.collection import Collection

#: Fields by which searches filter most, in whose order points lie.
LAYOUTS = {"code": ("role", "example_id"), "docs": ("chunk_type", "vtk_class")}


def missing(spark: SparkSession, config: Config) -> list[str]:
    """Input files that don't exist."""
    return [p for n in (*config.code_files.split(","), config.docs_file) if not storage.exists(spark, p := config.path(n))]


def code_of(spark: SparkSession, config: Config) -> DataFrame:
    """Records of all code files that exist, those without code too."""
    files = [p for n in config.code_files.split(",") if storage.exists(spark, p := config.path(n))]
    return reduce(DataFrame.unionByName, [jsonl.read_code_records(spark, f) for f in files])


def chunk(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """Chunks of all code files, united, and of the docs; written as Parquet and as JSON lines."""
    docs = jsonl.read_docs(spark, config.path(config.docs_file)).cache()
    classes = api_dim.api_classes(docs)
    code = jsonl.with_code(code_of(spark, config))
    found = {config.code_collection: code_chunks.chunk_code(code, classes), config.docs_collection: doc_chunks.chunk_docs(docs)}
    for name, rows in found.items():
        jsonl.write_parquet(rows, f"{config.processed_dir}/{name}")
    stored = {name: chunks(spark, config, name) for name in found}
    for name, rows in stored.items():
        jsonl.write_jsonl(rows, f"{config.processed_dir}/{name}-jsonl")
    docs.unpersist()
    return stored


def counts(spark: SparkSession, config: Config) -> DataFrame:
    """Code records read, without code too, chunks made of them, and files that gave any."""
    return report.counts(code_of(spark, config), chunks(spark, config, config.code_collection))


def chunks(spark: SparkSession, config: Config, name: str) -> DataFrame:
    """Stored chunks."""
    return spark.read.parquet(f"{config.processed_dir}/{name}")


def index(spark: SparkSession, config: Config, embedder: Embedder | None = None) -> dict[str, int]:
    """Collections of the chunks that exist, in the place of older ones; points by collection."""
    embedder = embedder or HashEmbedder(config.dimension)
    orders = {config.code_collection: (("example_id", "chunk_no"), LAYOUTS["code"]), config.docs_collection: (("vtk_class", "pos"), LAYOUTS["docs"])}
    out = {}
    for name, (order, layout) in orders.items():
        path = f"{config.processed_dir}/{name}"
        if not storage.exists(spark, path):
            print(f"no chunks at {path}", file=sys.stderr)
            continue
        built = Collection.create(name, f"{config.index_dir}/{name}", spark.read.parquet(path), embedder, order=order, layout=layout)
        out[name] = built.info().first()["points_count"]
    return out


def retriever(spark: SparkSession, config: Config, embedder: Embedder | None = None) -> Retriever:
    """Search over the collections that exist, by the defaults of the settings."""
    names = [n for n in (config.code_collection, config.docs_collection) if storage.exists(spark, f"{config.index_dir}/{n}")]
    collections = {n: Collection.read(spark, n, f"{config.index_dir}/{n}") for n in names}
    return Retriever(
        collections, embedder or HashEmbedder(config.dimension), config.prefetch, code=config.code_collection, docs=config.docs_collection, limit=config.top_k,
        least_visibility=config.min_visibility_score, hybrid=config.use_hybrid,
    )


def clean(spark: SparkSession, config: Config) -> list[str]:
    """Removes processed chunks and collections; what was there."""
    return [d for d in (config.processed_dir, config.index_dir) if storage.delete(spark, d)]


def build(spark: SparkSession, config: Config, chunks_only: bool = False, index_only: bool = False, force: bool = False) -> bool:
    """Chunk and index, or one of both; False if input files are missing."""
    if not index_only:
        if (lost := missing(spark, config)) and not force:
            print("missing:", *lost, file=sys.stderr)
            return False
        print({n: rows.count() for n, rows in chunk(spark, config).items()})
        print(counts(spark, config).first().asDict())
    if not chunks_only:
        print(index(spark, config))
    return True


def main(argv: list[str] | None = None, spark: SparkSession | None = None, config: Config | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m corvane.plans.build")
    steps = p.add_mutually_exclusive_group()
    steps.add_argument("--chunk", action="store_true", help="make chunks only")
    steps.add_argument("--index", action="store_true", help="make collections of stored chunks only")
    steps.add_argument("--clean", action="store_true", help="remove chunks and collections")
    p.add_argument("--force", action="store_true", help="go on though input files are missing")
    args = p.parse_args(argv)
    config = config or load_config()
    spark = spark or SparkSession.builder.appName("corvane").getOrCreate()
    if args.clean:
        print("removed:", *clean(spark, config) or ["nothing"])
        return 0
    return 0 if build(spark, config, args.chunk, args.index, args.force) else 1


if __name__ == "__main__":
    sys.exit(main())
