"""Registered queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import questions, scoring, text
from ..functions.embed import HashEmbedder
from ..functions.fixed import ARTICLES, FUNCTION_ACTIONS, LIFECYCLE_METHODS, MASS_NOUNS, METHOD_PREFIXES, METHOD_SUFFIXES, VERBS
from ..operators import api_dim, code_chunks, doc_chunks, report, retriever
from ..operators import filters as fl
from ..schemas import RAW_DOC
from ..sources import collection as coll
from ..sources import storage
from ..sources.jsonl import with_doc_defaults
from ..sources.late_index import LateIndex
from ..streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], *names: str) -> str:
    cell = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS v({', '.join(names)})"


def of_parts(spark: SparkSession, d: str, rows: list[tuple], *names: str) -> DataFrame:
    """A row a part: in turn one of the rows, with the part's name for {} (joined, each word a capital) and <> (by underscores)."""
    joined = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")
    which = F.element_at(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names, strict=True)]) for r in rows]), (F.pmod("p_partkey", F.lit(len(rows))) + 1).cast("int"))
    put = lambda n: F.replace(F.replace(F.col(f"r.{n}"), F.lit("{}"), joined), F.lit("<>"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return t(spark, d, "part").withColumn("r", which).select("p_partkey", *[put(n).alias(n) for n in names])


def of_parts_sql(rows: list[tuple], *names: str) -> str:
    joined = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '')"
    put = lambda n: f"replace(replace({n}, '{{}}', {joined}), '<>', replace(p_name, ' ', '_')) AS {n}"
    numbered = sql_values([(i, *r) for i, r in enumerate(rows)], "which", *names)
    return f"(SELECT p_partkey, {', '.join(map(put, names))} FROM part JOIN {numbered} ON p_partkey % {len(rows)} = which) AS made"


# -- ranked search ---------------------------------------------------------------------------------------------------

QUERY_TEXT = "the tion and thereof thing"
WORDS = sorted(set(QUERY_TEXT.split()))
IN = ", ".join(f"'{w}'" for w in WORDS)


def points(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.col("lang").alias("role"), F.col("source").alias("module"), "n_chars")


def turns(spark: SparkSession, d: str) -> DataFrame:
    rows = coll.with_positions(t(spark, d, "conversations"), "conv_id", "turn")
    return rows.select(F.col("position").alias("id"), F.coalesce("text", F.lit("")).alias("content"), "role")


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in t(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def bm25(rows: DataFrame, k: int, filters: dict | None = None) -> DataFrame:
    return retriever.sparse_scan(rows, QUERY_TEXT, k, condition=fl.build_filter(rows, filters))


def bm25_sql(table: str, key: str, k: int, where: str = "TRUE", name: str = "b", words: str = IN) -> str:
    return f"""{name}_tok AS (SELECT {key} AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w, * FROM {table}),
{name}_dl AS (SELECT id, len(w) AS dl FROM {name}_tok), {name}_st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM {name}_dl),
{name}_p AS (SELECT id, term, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(w) AS term FROM {name}_tok) x WHERE term IN ({words}) GROUP BY id, term),
{name}_df AS (SELECT term, count(*)::DOUBLE AS df FROM {name}_p GROUP BY term),
{name} AS (SELECT p.id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM {name}_p p JOIN {name}_df USING (term) JOIN {name}_dl USING (id) CROSS JOIN {name}_st WHERE p.id IN (SELECT id FROM {name}_tok WHERE {where}) GROUP BY p.id ORDER BY score DESC, p.id LIMIT {k})"""


def dense_sql(k: int, where: str = "TRUE", name: str = "d") -> str:
    return f"""{name}_q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
{name} AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, {name}_q WHERE {where} ORDER BY score DESC, id LIMIT {k})"""


def fuse_sql(a: str, b: str, k: int) -> str:
    branch = lambda x: f"SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM {x}"
    return f"SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM ({branch(a)} UNION ALL {branch(b)}) u GROUP BY id ORDER BY score DESC, id LIMIT {k}"


@query(f"WITH {dense_sql(10)} SELECT * FROM d")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return retriever.dense(vectors(spark, d), query_vector(spark, d), 10)


@query(f"WITH {dense_sql(10, 'label = 3')} SELECT * FROM d")
def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return retriever.dense(fl.where(vectors(spark, d), {"label": 3}), query_vector(spark, d), 10)


@query("WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT label::BIGINT AS id, round(max(list_cosine_similarity(embedding::DOUBLE[], q)), 6) AS score FROM embeddings, q WHERE vec_id <> 0 GROUP BY label ORDER BY score DESC, id LIMIT 10")
def multivector_maxsim(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).filter("id <> 0").select(F.col("label").cast("long").alias("id"), "vec")
    return retriever.multi_vector(rows, query_vector(spark, d), 10)


@query(f"WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), e AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM w) SELECT term, id, count(*) AS tf, max(dl)::BIGINT AS dl FROM e WHERE term IN ({IN}) GROUP BY term, id")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return coll.postings(points(spark, d)).filter(F.col("term").isin(WORDS))


@query("WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), e AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM w) SELECT term, id, count(*) AS tf, max(dl)::BIGINT AS dl FROM e GROUP BY term, id")
def postings_all(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index of every term; `postings` holds the query's terms alone."""
    return coll.postings(points(spark, d))


@query("WITH e AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df FROM e GROUP BY term")
def term_df(spark: SparkSession, d: str) -> DataFrame:
    words = points(spark, d).select(F.explode_outer(F.array_distinct(text.tokens("content"))).alias("term")).dropna()
    return words.groupBy("term").agg(F.count("*").alias("df"))


@query("SELECT count(*) AS n, round(avg(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))), 6) AS avgdl FROM documents")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return coll.corpus_stats(points(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


@query(f"WITH {bm25_sql('documents', 'doc_id', 10)} SELECT * FROM b")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25(points(spark, d), 10)


LANG = "lang = 'en'"


@query(f"WITH {bm25_sql('documents', 'doc_id', 10, LANG)} SELECT * FROM b")
def bm25_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return bm25(points(spark, d), 10, {"role": "en"})


def hybrid(spark: SparkSession, d: str, filters: dict | None, k: int = 10, prefetch: int = 20) -> DataFrame:
    """Documents and embeddings of equal id stand for one collection."""
    rows = points(spark, d)
    vecs = vectors(spark, d)
    vecs = vecs.join(fl.where(rows, filters).select("id"), "id", "left_semi") if filters else vecs
    return retriever.fuse([retriever.dense(vecs, query_vector(spark, d), prefetch), bm25(rows, prefetch, filters)], k)


def hybrid_sql(where: str | None = None, k: int = 10) -> str:
    inside = f"vec_id IN (SELECT doc_id FROM documents WHERE {where})" if where else "TRUE"
    return f"WITH {dense_sql(20, inside)}, {bm25_sql('documents', 'doc_id', 20, where or 'TRUE')} {fuse_sql('d', 'b', k)}"


@query(hybrid_sql())
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(spark, d, None)


@query(hybrid_sql(LANG))
def hybrid_rrf_filtered(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(spark, d, {"role": "en"})


@query(hybrid_sql("lang = 'de'"))
def search_by_role(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(spark, d, {"role": "de"})


@query(f"WITH {bm25_sql('documents', 'doc_id', 10, chr(115) + 'ource = ' + repr('src3'))} SELECT * FROM b")
def search_by_key(spark: SparkSession, d: str) -> DataFrame:
    return bm25(points(spark, d), 10, {"module": "src3"})


@query(hybrid_sql("lang = 'en' AND source = 'src1'"))
def search_by_two_keys(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(spark, d, {"role": "en", "module": "src1"})


@query(f"WITH {bm25_sql('documents', 'doc_id', 10)}, {bm25_sql('conversations', '(row_number() OVER (ORDER BY conv_id, turn) - 1)', 10, name='c')} SELECT collection, id, score FROM (SELECT 'docs' AS collection, 0 AS o, * FROM b UNION ALL SELECT 'conv', 1, * FROM c) u ORDER BY score DESC, o, id LIMIT 10")
def multi_collection_topk(spark: SparkSession, d: str) -> DataFrame:
    found = [bm25(points(spark, d), 10).withColumn("collection", F.lit("docs")), bm25(turns(spark, d), 10).withColumn("collection", F.lit("conv"))]
    return retriever.merge_collections(found, 10).select("collection", "id", "score")


@query("SELECT doc_id, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS bucket, count(*)::DOUBLE AS value FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents) x GROUP BY 1, 2")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    """The places of every document's vector that aren't 0."""
    vec = points(spark, d).select("id", HashEmbedder(64).column(F.col("content")).alias("v"))
    return vec.select(F.col("id").alias("doc_id"), F.posexplode("v").alias("bucket", "value")).filter("value <> 0")


# -- search over a stored index --------------------------------------------------------------------------------------


class GivenVector:
    """Encodes any query as one vector that is there already."""

    dimension = 0

    def __init__(self, vector: list[float]):
        self.vector = vector

    def one(self, t: str) -> list[float]:
        return self.vector


_BUILT: dict[tuple[str, str], coll.Collection] = {}


def indexed(spark: SparkSession, d: str) -> coll.Collection:
    """The collection of all documents, with the embeddings of equal id, built once in a session in the shared folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        rows = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.col("lang").alias("vtk_class"), F.col("lang").alias("role"), F.col("source").alias("module"), "n_chars")
        vecs = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
        path = f"{storage.shared_folder(spark)}/corvane-index-{key[0]}-{abs(hash(d))}"
        _BUILT[key] = coll.Collection.create("docs", path, rows, None, key="id", layout=("role",), indexed=("role", "module", "n_chars"), vectors=vecs)
    return _BUILT[key]


def engine(spark: SparkSession, d: str) -> retriever.Retriever:
    return retriever.Retriever({"docs": indexed(spark, d)}, GivenVector(query_vector(spark, d)), code="docs")


@query(f"WITH {bm25_sql('documents', 'doc_id', 10)} SELECT * FROM b")
def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).bm25_search(QUERY_TEXT).select("id", "score")


@query(f"WITH {bm25_sql('documents', 'doc_id', 10, LANG)} SELECT * FROM b")
def bm25_indexed_filtered(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).bm25_search(QUERY_TEXT, filters={"role": "en"}).select("id", "score")


@query(hybrid_sql("TRUE"))
def hybrid_indexed(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).hybrid_search(QUERY_TEXT).select("id", "score")


@query(hybrid_sql("lang = 'de'"))
def search_by_role_indexed(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).search_by_role(QUERY_TEXT, "de").select("id", "score")


@query(hybrid_sql("source = 'src1'"))
def search_by_module_indexed(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).search_by_module(QUERY_TEXT, "src1").select("id", "score")


CLASS_SQL = bm25_sql("documents", "doc_id", 10, "lang = 'de'", words="'de'")


@query(f"WITH {CLASS_SQL} SELECT id, 'de' AS class_name, score FROM b")
def search_by_class(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the class `de` by that word."""
    return engine(spark, d).search_by_class("de").select("id", "class_name", "score")


@query("SELECT doc_id AS id, lang AS role, coalesce(source, '') AS module FROM documents")
def scroll_indexed(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d).scroll(["id", "role", F.coalesce("module", F.lit("")).alias("module")])


@query(f"WITH {bm25_sql('documents', 'doc_id', 10)} SELECT * FROM b")
def bm25_blockmax(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d).block_max().search(QUERY_TEXT, 10)


@query(f"WITH {bm25_sql('documents', 'doc_id', 10, LANG)} SELECT * FROM b")
def bm25_blockmax_filtered(spark: SparkSession, d: str) -> DataFrame:
    c = indexed(spark, d)
    return c.block_max().search(QUERY_TEXT, 10, c.points.filter(F.col("role") == "en"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2') AND n_chars > 500")
def filter_bitmap(spark: SparkSession, d: str) -> DataFrame:
    found = indexed(spark, d).filtered({"role": "en", "module": ["src1", "src2"], "n_chars": {"gt": 500}})
    return found.select(F.col("id").alias("doc_id"))


@query(f"WITH {bm25_sql('documents', 'doc_id', 10, 'lang = ' + repr('en') + ' AND n_chars < 3000')} SELECT * FROM b")
def bm25_bitmap_filtered(spark: SparkSession, d: str) -> DataFrame:
    by = retriever.Retriever({"docs": indexed(spark, d)}, GivenVector(query_vector(spark, d)), code="docs", block_max=True, payload_index=True)
    return by.bm25_search(QUERY_TEXT, filters={"role": "en", "n_chars": {"lt": 3000}}).select("id", "score")


def with_vectors(spark: SparkSession, d: str) -> coll.Collection:
    """indexed() with an index of its vectors, built once in a session."""
    key = (spark.sparkContext.applicationId, f"{d} vectors")
    if key not in _BUILT:
        _BUILT[key] = indexed(spark, d).index_vectors()
    return _BUILT[key]


INDEXED = "vec_id IN (SELECT doc_id FROM documents)"


@query(f"WITH {dense_sql(10, INDEXED)} SELECT * FROM d")
def dense_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """Through the inverted file, with bounds instead of a calibrated number of visits."""
    return with_vectors(spark, d).nearest(query_vector(spark, d), 10, exact=True)


@query(f"WITH {dense_sql(10, INDEXED.replace(')', ' WHERE source = ' + repr('src3') + ')'))} SELECT * FROM d")
def dense_index_filtered(spark: SparkSession, d: str) -> DataFrame:
    return with_vectors(spark, d).nearest(query_vector(spark, d), 10, F.col("module") == "src3", exact=True)


def upserted(spark: SparkSession, d: str) -> coll.Collection:
    """All documents, of which a tenth is then replaced, a tenth removed and a tenth added again under new ids."""
    key = (spark.sparkContext.applicationId, f"{d} upserted")
    if key not in _BUILT:
        rows = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.col("lang").alias("role"), F.array(F.lit(1.0)).alias("vec"))
        path = f"{storage.shared_folder(spark)}/corvane-upserted-{key[0]}-{abs(hash(d))}"
        first = coll.Collection.create("docs", path, rows, None, key="id", layout=("role",), positional=True)
        changed = rows.filter("id % 10 = 3").withColumn("content", F.concat("content", F.lit(" thereof Thing")))
        added = rows.filter("id % 10 = 5").withColumn("id", F.col("id") + 1_000_000_000)
        _BUILT[key] = first.upsert(changed.unionByName(added)).upsert(removed=rows.filter("id % 10 = 7"))
    return _BUILT[key]


UPSERTED = """n AS (SELECT CASE WHEN doc_id % 10 = 3 THEN coalesce(text, '') || ' thereof Thing' ELSE text END AS text, doc_id, lang FROM documents WHERE doc_id % 10 <> 7
UNION ALL SELECT text, doc_id + 1000000000, lang FROM documents WHERE doc_id % 10 = 5)"""


@query(f"WITH {UPSERTED}, {bm25_sql('n', 'doc_id', 10, LANG)} SELECT * FROM b")
def upsert_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Search after upserts, by statistics kept up by differences."""
    return retriever.Retriever({"docs": upserted(spark, d)}, GivenVector([1.0]), code="docs", block_max=True).bm25_search(QUERY_TEXT, filters={"role": "en"}).select("id", "score")


@query(f"WITH {UPSERTED}, e AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM n) SELECT term, count(DISTINCT doc_id) AS df FROM e GROUP BY term")
def upsert_term_stats(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies of all terms after upserts."""
    return upserted(spark, d).term_stats


@query(f"WITH {UPSERTED} SELECT doc_id FROM n WHERE list_has_all(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ['the', 'and', 'of'])")
def match_words(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold all words, by their stored lists, after upserts."""
    return upserted(spark, d).words("of the and").select(F.col("id").alias("doc_id"))


@query(f"""WITH {UPSERTED}, w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM n)
SELECT * FROM (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'the' AND w[i + 1] = 'the')) AS n FROM w) x WHERE n > 0""")
def match_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a phrase and how often it stands there, occurrences that overlap each, after upserts."""
    return upserted(spark, d).phrase("The the").select(F.col("id").alias("doc_id"), F.size("starts").cast("long").alias("n"))


@query(f"WITH {UPSERTED}, {bm25_sql('n', 'doc_id', 10, LANG + ' AND contains(chr(32) || array_to_string(w, chr(32)) || chr(32), ' + repr(' the of ') + ')', words=repr('the') + ', ' + repr('of'))} SELECT * FROM b")
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    """The best documents by BM25 among those of a language that hold a phrase."""
    return retriever.Retriever({"docs": upserted(spark, d)}, GivenVector([1.0]), code="docs").phrase_search("the of", filters={"role": "en"}).select("id", "score")


@query("SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ['the', 'and']) AND contains(' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ') || ' ', ' of the ')")
def filter_text(spark: SparkSession, d: str) -> DataFrame:
    """Words and a phrase as conditions on texts without an index."""
    docs = t(spark, d, "documents")
    return docs.filter(fl.FilterBuilder(docs).match_text("text", "and THE").match_phrase("text", "of the").build()).select("doc_id")


def late(spark: SparkSession, d: str) -> LateIndex:
    """All embeddings, four a point, in lists; built once in a session in the shared folder."""
    path = f"{storage.shared_folder(spark)}/corvane-late-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    if storage.exists(spark, f"{path}/centres.json"):
        return LateIndex(spark, path)
    return LateIndex.build(t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("id"), F.col("embedding").alias("vec")), path)


@query("WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id // 4 AS id, round(max(list_cosine_similarity(embedding::DOUBLE[], q)), 6) AS score FROM embeddings, q GROUP BY 1 ORDER BY score DESC, id LIMIT 10")
def multivector_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Points of four vectors by their largest cosine, through lists with bounds."""
    return late(spark, d).search(query_vector(spark, d), 10)


def streamed(spark: SparkSession, d: str) -> coll.Collection:
    """All documents as they came through a stream into a collection."""
    key = (spark.sparkContext.applicationId, f"{d} streamed")
    if key not in _BUILT:
        source = spark.readStream.schema(t(spark, d, "documents").schema)
        # a stream's source is a folder: that of the table, or the one in which the table is a file
        source = source.parquet(f"{d}/documents.parquet") if storage.is_folder(spark, f"{d}/documents.parquet") else source.option("pathGlobFilter", "documents.parquet").parquet(d)
        rows = source.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.col("lang").alias("role"), F.array(F.lit(1.0)).alias("vec"))
        path = f"{storage.shared_folder(spark)}/corvane-streamed-{key[0]}-{abs(hash(d))}"
        ingest.stream_collection(rows, "docs", path, None, f"{path}-checkpoint", layout=("role",)).awaitTermination()
        _BUILT[key] = coll.Collection.read(spark, "docs", path)
    return _BUILT[key]


@query(f"WITH {bm25_sql('documents', 'doc_id', 10, LANG)} SELECT * FROM b")
def bm25_streamed(spark: SparkSession, d: str) -> DataFrame:
    """Search in what a stream has brought, by statistics kept up batch by batch."""
    return retriever.Retriever({"docs": streamed(spark, d)}, GivenVector([1.0]), code="docs").bm25_search(QUERY_TEXT, filters={"role": "en"}).select("id", "score")


# -- filters ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE lang = 'fr'")
def filter_exact(spark: SparkSession, d: str) -> DataFrame:
    return fl.where(t(spark, d, "documents"), {"lang": "fr"}).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang IN ('de', 'es')")
def filter_any(spark: SparkSession, d: str) -> DataFrame:
    return fl.where(t(spark, d, "documents"), {"lang": ["de", "es"]}).select("doc_id")


@query("SELECT doc_id FROM documents WHERE n_chars >= 1000 AND n_chars < 3000")
def filter_range(spark: SparkSession, d: str) -> DataFrame:
    return fl.where(t(spark, d, "documents"), {"n_chars": {"gte": 1000, "lt": 3000, "lte": None, "other": 1}}).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2') AND n_chars > 500")
def filter_combined(spark: SparkSession, d: str) -> DataFrame:
    return fl.where(t(spark, d, "documents"), {"lang": "en", "source": ["src1", "src2"], "n_chars": {"gt": 500}}).select("doc_id")


@query("SELECT doc_id, CAST(source = 'src4' AS INT) AS boost FROM documents WHERE lang IN ('en', 'fr') AND source IS DISTINCT FROM 'src0' AND n_chars <= 2000")
def filter_builder_exclude(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    b = fl.FilterBuilder(docs).match_any("lang", ["en", "fr"]).exclude("source", "src0").range("n_chars", lte=2000).should_match("source", "src4")
    return docs.filter(b.build()).select("doc_id", b.boost().alias("boost"))


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY source HAVING list_contains(list(DISTINCT lang), 'es')")
def array_membership_filter(spark: SparkSession, d: str) -> DataFrame:
    by = t(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    return fl.where(by, {"langs": "es"}).select("source", F.array_join("langs", ",").alias("langs"))


@query("SELECT doc_id AS id, coalesce(nullif(CAST(CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS VARCHAR), ''), source, '') AS module, coalesce(lang, '') AS role, coalesce(text, '') AS content FROM documents LEFT JOIN labels USING (doc_id)")
def result_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    rows = rows.select(F.col("doc_id").alias("id"), F.lit(1.0).alias("score"), F.col("text").alias("content"), F.col("lang").alias("role"), F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("module"), F.struct(F.col("source").alias("module")).alias("metadata"))
    return retriever.project_result(rows, "docs").select("id", "module", "role", "content")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN coalesce(text, '') ELSE 'quality ' || quality END AS asked FROM documents LEFT JOIN labels USING (doc_id)")
def queries_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    asked = F.when(F.col("quality").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("quality "), F.col("quality").cast("string"))))
    return coll.asked_texts(rows.select("doc_id", "text", asked.alias("queries")), "doc_id", "text").select("doc_id", F.col("q").alias("asked"))


@query("SELECT page_id, contains(url, 'utm_source') AS flag FROM pages")
def flag_contains(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", code_chunks.is_pythonic(F.col("url"), "utm_source").alias("flag"))


def members(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as members of a group, in order: the role is the class, a long text has the property `long`."""
    none = F.array().cast("array<struct<variable:string,class:string>>")
    long = F.when(F.length("text") > 200, F.array(F.struct(F.lit("x").alias("variable"), F.lit("long").alias("class")))).otherwise(none)
    own = F.struct("turn", F.struct(F.col("role").alias("class"), F.when(F.col("role") != "system", F.col("role")).otherwise("").alias("role"), long.alias("properties")).alias("m"))
    by = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("c"))
    return by.select("conv_id", F.transform("c", lambda x: x["m"]).alias("members"))


@query("""WITH e AS (SELECT conv_id, turn, 0 AS p, role AS name FROM conversations UNION ALL SELECT conv_id, turn, 1, 'long' FROM conversations WHERE length(text) > 200),
f AS (SELECT conv_id, name, min(turn * 2 + p) AS first FROM e GROUP BY conv_id, name) SELECT conv_id, string_agg(name, ',' ORDER BY first) AS names FROM f GROUP BY conv_id""")
def struct_array_flatten(spark: SparkSession, d: str) -> DataFrame:
    return members(spark, d).select("conv_id", F.array_join(code_chunks.class_names(F.col("members")), ",").alias("names"))


# -- joins -----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, coalesce(n_name, 'utility') AS role FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey")
def dim_lookup_role(spark: SparkSession, d: str) -> DataFrame:
    dim = t(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("role"))
    return api_dim.lookup(t(spark, d, "customer"), dim, "c_nationkey").select("c_custkey", api_dim.role().alias("role"))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def dim_lookup_inner(spark: SparkSession, d: str) -> DataFrame:
    dim = t(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return api_dim.lookup(t(spark, d, "supplier"), dim, "s_nationkey", "inner").select("s_suppkey", "n_name")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_known(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left_semi").select("doc_id")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def anti_join_orphans(spark: SparkSession, d: str) -> DataFrame:
    used = t(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return t(spark, d, "part").join(used, "p_partkey", "left_anti").select("p_partkey")


@query("SELECT a.n_name AS name, coalesce(b.n_name, '') AS parent FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_regionkey + 20")
def parent_self_join(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation")
    up = n.select((F.col("n_nationkey") - 20).alias("n_regionkey"), F.col("n_name").alias("parent"))
    return n.join(api_dim.dimension(up), "n_regionkey", "left").select(F.col("n_name").alias("name"), F.coalesce("parent", F.lit("")).alias("parent"))


@query("SELECT class, CAST(place AS INT) AS place FROM (SELECT DISTINCT p_name AS class, CASE WHEN contains(lower(p_name), 'an') THEN 0 WHEN contains(lower(p_type), 'an') THEN 1 END AS place FROM (SELECT p_name, min(p_type) AS p_type FROM part GROUP BY p_name) x) y WHERE place IS NOT NULL ORDER BY place, class LIMIT 10")
def class_search(spark: SparkSession, d: str) -> DataFrame:
    dim = t(spark, d, "part").groupBy(F.col("p_name").alias("class")).agg(F.min("p_type").alias("synopsis"))
    return api_dim.search_classes(dim, "AN").select("class", "place")


# -- aggregates and windows ------------------------------------------------------------------------------------------


@query("SELECT lang, round(avg(coalesce(nullif(quality, 0), 0.5)), 6) AS visibility FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def avg_default(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "documents").join(t(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("visibility_score")), "doc_id", "left")
    return rows.groupBy("lang").agg(F.round(F.avg(api_dim.visibility()), 6).alias("visibility"))


@query("SELECT coalesce(event_type, 'unknown') AS chunk_type, count(*) AS n FROM events GROUP BY 1")
def count_by_type(spark: SparkSession, d: str) -> DataFrame:
    return doc_chunks.count_by_type(t(spark, d, "events").select(F.col("event_type").alias("chunk_type")))


@query("SELECT 'documents' AS name, count(*) AS points_count FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def collection_info(spark: SparkSession, d: str) -> DataFrame:
    one = lambda n: coll.Collection(n, *[t(spark, d, n)] * 5).info().select("name", "points_count")
    return one("documents").unionByName(one("pages")).unionByName(one("embeddings"))


@query("SELECT conv_id, string_agg(role || ':' || turn, ' → ' ORDER BY turn) AS flow FROM conversations GROUP BY conv_id")
def ordered_string_agg(spark: SparkSession, d: str) -> DataFrame:
    each = t(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(":", "role", F.col("turn").cast("string")).alias("x"))
    return each.groupBy("conv_id").agg(code_chunks.joined(F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda s: s["x"])).alias("flow"))


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ', ') AS langs FROM documents GROUP BY source")
def collect_set_sorted(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ", ").alias("langs"))


@query("SELECT conv_id, coalesce(arg_min(role, turn) FILTER (WHERE role <> 'system'), '') AS role FROM conversations GROUP BY conv_id")
def first_nonempty(spark: SparkSession, d: str) -> DataFrame:
    return members(spark, d).select("conv_id", code_chunks.first_role(F.col("members")).alias("role"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS content, arg_min(role, turn) AS first_role, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY conv_id")
def merge_by_key(spark: SparkSession, d: str) -> DataFrame:
    by = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("c"))
    answer = F.get(F.filter("c", lambda x: x["role"] == "assistant"), F.lit(0))["text"]
    return by.select("conv_id", F.array_join(F.transform("c", lambda x: x["text"]), "\n").alias("content"), F.get("c", F.lit(0))["role"].alias("first_role"), answer.alias("answer"))


@query("SELECT coalesce(lang, 'unknown') AS lang, doc_id, CAST(rn AS INT) AS rn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY coalesce(lang, 'unknown') ORDER BY doc_id) AS rn FROM documents) x WHERE rn <= 2")
def sample_per_group(spark: SparkSession, d: str) -> DataFrame:
    return retriever.sample_per_group(t(spark, d, "documents"), "lang", 2, "doc_id").select("lang", "doc_id", "rn")


def users(spark: SparkSession, d: str) -> DataFrame:
    """A user's events in order, as calls: name and arguments."""
    each = F.struct("event_id", F.struct(F.col("event_type").alias("name"), F.array(F.col("event_id").cast("string")).alias("args")).alias("call"))
    by = t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(each)).alias("c"))
    return by.select("user_id", F.transform("c", lambda x: x["call"]).alias("calls"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The row form: a partial minimum before the shuffle, no sort."""
    return t(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) x GROUP BY user_id")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return users(spark, d).select("user_id", F.array_join(text.dedupe_first(F.transform("calls", lambda c: c["name"])), ",").alias("kinds"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents), e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w)
SELECT doc_id, string_agg(x, ',' ORDER BY i) AS words FROM (SELECT doc_id, arg_min(x, i) AS x, min(i) AS i FROM e GROUP BY doc_id, lower(x)) y GROUP BY doc_id""")
def dedupe_ci(spark: SparkSession, d: str) -> DataFrame:
    """First spellings of the ASCII words of each document that has any."""
    first = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    return t(spark, d, "documents").select("doc_id", F.array_join(text.dedupe_ci(first), ",").alias("words")).filter("words <> ''")


@query("SELECT user_id, event_type, min(event_id)::VARCHAR AS args FROM events GROUP BY user_id, event_type")
def dedupe_calls(spark: SparkSession, d: str) -> DataFrame:
    once = users(spark, d).select("user_id", F.explode(code_chunks.first_by_name(F.col("calls"))).alias("c"))
    return once.select("user_id", F.col("c.name").alias("event_type"), F.array_join("c.args", ",").alias("args"))


@query("SELECT user_id, array_to_string(list_slice(list(event_type ORDER BY event_id), 1, 8), ',') AS calls FROM events GROUP BY user_id")
def slice_first_n(spark: SparkSession, d: str) -> DataFrame:
    return users(spark, d).select("user_id", F.array_join(F.transform(code_chunks.first_calls(F.col("calls")), lambda c: c["name"]), ",").alias("calls"))


@query("SELECT p_brand, array_to_string(list_slice(n, 1, 30), ', ') || CASE WHEN len(n) > 30 THEN chr(10) || '... and ' || (len(n) - 30) || ' more' ELSE '' END AS listed FROM (SELECT p_brand, list_sort(list(DISTINCT p_name)) AS n FROM part GROUP BY p_brand) x")
def top_n_list_overflow(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("n")).select("p_brand", text.top_n_list("n", doc_chunks.SHOWN_METHODS).alias("listed"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chunk_no FROM conversations")
def running_chunk_no(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("chunk_no"))


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS position FROM conversations")
def row_position_id(spark: SparkSession, d: str) -> DataFrame:
    return coll.with_positions(t(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


# -- names and texts -------------------------------------------------------------------------------------------------

NAMES = [("vtkSphereSource",), ("vtkLUTSize",), ("vtkmDataSet",), ("Plain",), ("vtk",), ("phiResolution",), ("theta_resolution",), ("a",), ("",), ("ABC",), ("vtk{}",), ("vtkm{}Filter",), ("<>",), ("{}",)]


def names(spark: SparkSession, d: str) -> DataFrame:
    return of_parts(spark, d, NAMES, "name")


CAMEL = lambda x: f"lower(ltrim(regexp_replace({x}, '([A-Z])', ' \\1', 'g')))"
CAP = lambda x: f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"
NAMES_SQL = of_parts_sql(NAMES, "name")


@query(f"SELECT p_partkey, name, {CAMEL('name')} AS words FROM {NAMES_SQL}")
def camel_to_words(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("p_partkey", "name", text.camel_to_words("name").alias("words"))


@query(f"SELECT doc_id, {CAP('text')} AS capital, {CAP('lang')} AS lang FROM documents")
def capitalize_first(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", text.capitalize_first("text").alias("capital"), text.capitalize_first("lang").alias("lang"))


@query(f"SELECT p_partkey, name, 'Set' || {CAP('lower(name)')} AS setter FROM {NAMES_SQL}")
def attr_to_setter(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("p_partkey", "name", text.attr_to_setter("name").alias("setter"))


@query(f"SELECT p_partkey, name, CASE WHEN b = '' THEN lower(name) ELSE lower(substr(b, 1, 1)) || substr(b, 2) END AS var FROM (SELECT p_partkey, name, CASE WHEN starts_with(name, 'vtkm') THEN substr(name, 5) WHEN starts_with(name, 'vtk') THEN substr(name, 4) ELSE name END AS b FROM {NAMES_SQL}) x")
def class_to_var(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("p_partkey", "name", text.class_to_var("name").alias("var"))


def quoted(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def article_sql(x: str) -> str:
    return f"CASE WHEN trim({x}) = '' THEN '' WHEN lower(regexp_extract(trim({x}), '^\\S+')) IN ({quoted((*MASS_NOUNS, *ARTICLES))}) THEN {x} WHEN lower(substr({x}, 1, 1)) IN ({quoted('aeiou')}) THEN 'an ' || {x} ELSE 'a ' || {x} END"


@query(f"SELECT p_partkey, {article_sql('p_name')} AS phrase FROM part")
def with_article(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", text.with_article("p_name").alias("phrase"))


@query("SELECT page_id, CASE WHEN contains(url, '/') THEN string_split(url, '/')[-2] ELSE url END AS segment FROM pages")
def path_segment(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", text.path_segment("url").alias("segment"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS shown FROM documents")
def preview_truncate(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", text.preview("text", 100).alias("shown"))


PHRASES = [("isosurface generation",), ("data reading",), ("2D chart rendering",), ("rendering",), ("sphere",), ("",), ("the plane cutting",), ("event interaction",), ("image to grid conversion",), ("information",), ("<> rendering",), ("<>",), ("{} reading",)]
VERB_CASE = "CASE last " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VERBS.items()) + " END"


@query(f"SELECT p_partkey, phrase, CASE WHEN phrase = '' THEN NULL WHEN verb IS NULL THEN 'How do you use ' || phrase || '?' WHEN subject = '' THEN 'How do you ' || verb || '?' ELSE 'How do you ' || verb || ' ' || ({article_sql('subject')}) || '?' END AS question FROM (SELECT *, {VERB_CASE} AS verb FROM (SELECT p_partkey, phrase, regexp_extract(phrase, '\\S+$') AS last, trim(regexp_replace(phrase, '\\S+$', '')) AS subject FROM {of_parts_sql(PHRASES, 'phrase')}) x) y")
def phrase_to_question(spark: SparkSession, d: str) -> DataFrame:
    return of_parts(spark, d, PHRASES, "phrase").select("p_partkey", "phrase", questions.class_to_question(F.col("phrase")).alias("question"))


METHODS = [("SetRadius", "sphere"), ("AddRenderer", "render window"), ("VisibilityOn", "actor"), ("ShadingOff", "data"), ("GetOutput", "sphere"), ("Update", "sphere"), ("Set", "image"), ("RemoveAllLights", "scene"), ("Orient", "axis"), ("ComputeNormals", "mesh"), ("BuildLUT", "table"), ("Set{}", "<>"), ("Add{}", "the <>"), ("{}On", "{}"), ("{}Off", "<>"), ("Get{}", "<>"), ("Compute{}", "data"), ("Remove{}", "")]


def method_sql() -> str:
    cases = [f"WHEN starts_with(method, '{p}') THEN CASE WHEN length(method) = {len(p)} THEN 'How do you {v} ' || subject || '?' ELSE 'How do you {v} {a} ' || {CAMEL(f'substr(method, {len(p) + 1})')} || ' {o} ' || subject || '?' END" for p, v, a, o, _ in METHOD_PREFIXES]
    cases += [f"WHEN ends_with(method, '{s}') THEN 'How do you {v} ' || {CAMEL(f'substr(method, 1, length(method) - {len(s)})')} || ' on ' || subject || '?'" for s, v, _ in METHOD_SUFFIXES]
    return f"CASE WHEN starts_with(method, 'Get') OR method IN ({quoted(LIFECYCLE_METHODS)}) THEN NULL {' '.join(cases)} ELSE 'How do you ' || {CAMEL('method')} || ' ' || subject || '?' END"


@query(f"SELECT p_partkey, method, phrase, {method_sql()} AS question FROM (SELECT *, {article_sql('phrase')} AS subject FROM {of_parts_sql(METHODS, 'method', 'phrase')}) x")
def method_to_question(spark: SparkSession, d: str) -> DataFrame:
    return of_parts(spark, d, METHODS, "method", "phrase").select("p_partkey", "method", "phrase", questions.method_to_question(F.col("method"), F.col("phrase")).alias("question"))


FUNCTIONS = [("make_hexahedron",), ("makeHexahedron",), ("create_lookup_table",), ("helper",), ("my_helper",), ("addActor2",), ("get_items",), ("_private",), ("make_<>",), ("create{}",), ("<>",), ("_<>",)]


@query(f"""SELECT p_partkey, name, CASE WHEN len(p) < 2 THEN 'how to use ' || name WHEN lower(p[1]) IN ({quoted(FUNCTION_ACTIONS)}) THEN 'how to ' || lower(p[1]) || CASE WHEN substr(lower(p[2]), 1, 1) IN ({quoted('aeiou')}) THEN ' an ' ELSE ' a ' END || lower(array_to_string(p[2:], ' ')) ELSE 'how to use ' || lower(array_to_string(p, ' ')) END AS question
FROM (SELECT p_partkey, name, CASE WHEN len(s) = 1 THEN regexp_extract_all(name, '[a-z]+|[A-Z][a-z]*') ELSE s END AS p FROM (SELECT p_partkey, name, list_filter(string_split(name, '_'), lambda x: x <> '') AS s FROM {of_parts_sql(FUNCTIONS, 'name')}) x) y""")
def funcname_to_question(spark: SparkSession, d: str) -> DataFrame:
    return of_parts(spark, d, FUNCTIONS, "name").select("p_partkey", "name", questions.function_to_question(F.col("name")).alias("question"))


CALLS = [("SetRadius", "2.5"), ("SetCenter", "1.0|2.0|3.0"), ("AddRenderer", "ren"), ("CreateDefaultLookupTable", ""), ("ShadingOn", ""), ("GetOutput", ""), ("Render", ""), ("Orient", "x|y"), ("Orient", ""), ("Reset", ""), ("SetFlag", ""), ("Set{}", "<>"), ("Set{}", "1|<>"), ("Add{}", "<>"), ("{}On", ""), ("{}Off", ""), ("Get{}", "1"), ("Align{}", "<>")]


def call_sql() -> str:
    cases = []
    for p, *_, done in METHOD_PREFIXES:
        thing = CAMEL(f"substr(method, {len(p) + 1})")
        plain = f"CASE WHEN length(method) = {len(p)} THEN '{done}' ELSE {thing} || ' {done}' END"
        cases.append(f"WHEN starts_with(method, '{p}') THEN " + (f"CASE WHEN len(a) = 1 THEN {thing} || ' {done} ' || a[1] WHEN len(a) > 1 THEN {thing} || ' {done} (' || array_to_string(a, ', ') || ')' ELSE {plain} END" if p == "Set" else plain))
    cases += [f"WHEN ends_with(method, '{s}') THEN {CAMEL(f'substr(method, 1, length(method) - {len(s)})')} || ' {done}'" for s, _, done in METHOD_SUFFIXES]
    return f"CASE WHEN starts_with(method, 'Get') OR method IN ({quoted(LIFECYCLE_METHODS)}) THEN NULL {' '.join(cases)} WHEN len(a) > 0 THEN {CAMEL('method')} || ' with ' || array_to_string(a, ', ') END"


@query(f"SELECT p_partkey, method, args, {call_sql()} AS phrase FROM (SELECT p_partkey, method, args, CASE WHEN args = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(args, '|') END AS a FROM {of_parts_sql(CALLS, 'method', 'args')}) x")
def call_to_phrase(spark: SparkSession, d: str) -> DataFrame:
    rows = of_parts(spark, d, CALLS, "method", "args")
    args = F.when(F.col("args") == "", F.array().cast("array<string>")).otherwise(F.split("args", r"\|"))
    return rows.withColumn("a", args).select("p_partkey", "method", "args", questions.call_to_phrase(F.col("method"), F.col("a")).alias("phrase"))


#: Word characters of Spark's Unicode classes, for RE2.
RE2_WORD = r"[\pL\pM\p{Nd}\p{Nl}\p{Pc}]"


@query(f"SELECT page_id, regexp_extract(replace(html, '<title>', 'Superclass: '), 'Superclass:\\s*({RE2_WORD}+)', 1) AS parent FROM pages")
def regex_extract(spark: SparkSession, d: str) -> DataFrame:
    """The first word of a page's title, which stands where documentation names a parent."""
    return t(spark, d, "pages").select("page_id", text.superclass(F.replace("html", F.lit("<title>"), F.lit("Superclass: "))).alias("parent"))


LINKED = "replace(replace(url, 'http://', 'vtk.vtk'), '/', ' self.')"


@query(f"SELECT page_id, regexp_replace(regexp_replace({LINKED}, '\\bvtk\\.(vtk\\w+)', '\\1', 'g'), '\\bself\\.(\\w+)', '\\1', 'g') AS code, replace({LINKED}, 'self.', '') AS bare FROM pages")
def regex_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of pages, written like attributes of `vtk` and `self`."""
    line = F.replace(F.replace("url", F.lit("http://"), F.lit("vtk.vtk")), F.lit("/"), F.lit(" self."))
    return t(spark, d, "pages").select("page_id", text.rewrite_code(line).alias("code"), text.strip_self(line).alias("bare"))


@query("SELECT doc_id, coalesce(trim(list_filter(string_split(trim(text), chr(10)), lambda x: trim(x) <> '' AND NOT contains(x, '->') AND NOT starts_with(x, 'The'))[-1]), '') AS line FROM documents")
def last_matching_line(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", text.last_matching_line("text", F.lit("The")).alias("line"))


@query("SELECT r_name, string_agg('from ' || r_name || ' import ' || n, chr(10)) AS lines FROM (SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name) x GROUP BY r_name")
def import_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "nation").join(api_dim.dimension(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    by = rows.groupBy("r_name").agg(F.collect_list(F.struct(F.col("n_name").alias("class"), F.col("r_name").alias("module"))).alias("c"))
    return by.select("r_name", code_chunks.import_lines(F.col("c")).alias("lines"))


def part_docs(spark: SparkSession, d: str) -> DataFrame:
    """A documentation record a part: its type is the phrase, every third one has a parent."""
    p = t(spark, d, "part")
    name = lambda k: F.concat(F.lit("vtkPart"), k.cast("string"))
    doc = F.when((F.col("p_partkey") % 3 == 0) & (F.col("p_partkey") > 0), F.concat("p_name", F.lit("\nSuperclass: "), name(F.col("p_partkey") - 1))).when(F.col("p_partkey") % 3 < 2, F.col("p_name")).otherwise(F.lit(""))
    methods = F.create_map(F.lit("SetSize"), F.concat(F.lit("SetSize(n)\nSets size "), F.col("p_size").cast("string")), F.lit("_hidden"), F.lit("_hidden()"))
    raw = p.select(
        name(F.col("p_partkey")).alias("class_name"), F.col("p_brand").alias("module_name"), doc.alias("class_doc"), F.col("p_name").alias("synopsis"), F.lower("p_type").alias("action_phrase"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("double").alias("visibility_score"), F.lit(None).cast("string").alias("input_datatype"), F.lit(None).cast("string").alias("output_datatype"),
        F.lit(None).cast("array<string>").alias("semantic_methods"), F.struct(F.create_map(F.lit("Methods defined here"), F.struct(methods.alias("methods"))).alias("sections")).alias("structured_docs"),
    )
    assert [f.name for f in RAW_DOC.fields] == raw.columns
    return with_doc_defaults(raw)


def part_chunk(pos: str, kind: str, suffix: str, content: str, synopsis: str, phrase: str, asked: str, source: str = "p") -> str:
    """SELECT of one kind of chunk of the parts; an empty question is left out."""
    return f"SELECT {pos} AS pos, c || '_{suffix}' AS chunk_id, '{kind}' AS chunk_type, {content} AS content, {synopsis} AS synopsis, {phrase} AS action_phrase, m AS module, 'utility' AS role, 0.3::DOUBLE AS visibility_score, array_to_string(list_filter({asked}, lambda x: x IS NOT NULL), chr(10)) AS queries FROM {source}"


def phrase_sql(x: str) -> str:
    """Question for a phrase that isn't null."""
    last, rest = f"regexp_extract({x}, '\\S+$')", f"trim(regexp_replace({x}, '\\S+$', ''))"
    verb = VERB_CASE.replace("CASE last", f"CASE {last}")
    return f"CASE WHEN {x} = '' THEN NULL WHEN {verb} IS NULL THEN 'How do you use ' || {x} || '?' WHEN {rest} = '' THEN 'How do you ' || {verb} || '?' ELSE 'How do you ' || {verb} || ' ' || ({article_sql(rest)}) || '?' END"


NL = "chr(10)"
PARTS_SQL = f"""WITH p AS (SELECT 'vtkPart' || p_partkey AS c, 'part' || p_partkey AS v, p_brand AS m, p_name AS s, lower(p_type) AS a, p_size, p_partkey AS k,
  CASE WHEN p_partkey % 3 = 0 AND p_partkey > 0 THEN p_name || {NL} || 'Superclass: vtkPart' || (p_partkey - 1) WHEN p_partkey % 3 < 2 THEN p_name ELSE '' END AS doc FROM part),
q AS (SELECT *, CASE WHEN doc <> '' THEN 1 ELSE 0 END AS o FROM p), h AS (SELECT x.*, coalesce({NL} || '**Superclass Module:** `' || y.m || '`', '') AS up FROM q x LEFT JOIN p y ON y.k = x.k - 1 WHERE x.k % 3 = 0 AND x.k > 0)
""" + "\nUNION ALL ".join([
    part_chunk("0", "class_overview", "overview", f"'# ' || c || {NL} || {NL} || doc || {NL} || {NL} || '## Methods' || {NL} || 'SetSize'", "'Overview of ' || c || ': ' || s", "CASE WHEN a <> '' THEN 'overview of ' || a ELSE c || ' overview' END",
               f"[{phrase_sql('a')}, 'What is ' || c || '?', 'What does ' || c || ' do?', 'How do I use ' || c || '?']", "q WHERE doc <> ''"),
    part_chunk("o", "constructor", "constructor", f"'# ' || c || ' Constructor' || {NL} || {NL} || v || ' = ' || c || '()'", "'Create ' || c || CASE WHEN s <> '' THEN ' - ' || s ELSE '' END", "c || ' constructor'", "['How to create ' || c || '?', c || ' constructor']", "q"),
    part_chunk("o + 1", "method", "SetSize", f"'# ' || c || '.SetSize' || {NL} || {NL} || 'SetSize(n)' || {NL} || 'Sets size ' || p_size", "c || '.SetSize() - Sets size ' || p_size", "c || ' set size'",
               f"[CASE WHEN a <> '' THEN 'How do you set the size of ' || ({article_sql('a')}) || '?' END, 'How to use ' || c || '.SetSize']", "q"),
    part_chunk("o + 2", "method", "_hidden", f"'# ' || c || '._hidden' || {NL} || {NL} || '_hidden()'", "c || '._hidden()'", "c || ' _hidden'",
               f"[CASE WHEN a <> '' THEN 'How do you _hidden ' || ({article_sql('a')}) || '?' END, 'How to use ' || c || '._hidden']", "q"),
    part_chunk("o + 3", "inheritance", "inheritance", f"'# ' || c || ' Inheritance' || {NL} || {NL} || '**Superclass:** `vtkPart' || (k - 1) || '`' || up", "c || ' inherits from vtkPart' || (k - 1)", "''",
               "['What does ' || c || ' inherit from?', c || ' parent class', c || ' base class']", "h"),
])


@query(PARTS_SQL)
def doc_chunks_of_parts(spark: SparkSession, d: str) -> DataFrame:
    chunks = doc_chunks.chunk_docs(part_docs(spark, d))
    return chunks.select("pos", "chunk_id", "chunk_type", "content", "synopsis", "action_phrase", "module", "role", "visibility_score", F.array_join("queries", "\n").alias("queries"))


@query("SELECT role, CAST(rn AS INT) AS rn, CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || '...' ELSE text END AS content FROM (SELECT role, text, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS rn FROM conversations) x WHERE rn <= 3")
def sample_report(spark: SparkSession, d: str) -> DataFrame:
    return report.sample_by_role(t(spark, d, "conversations").withColumnRenamed("text", "content"), 3, "conv_id", "turn")


# -- code ------------------------------------------------------------------------------------------------------------

SNIPPETS = [
    ("https://host/PythonicAPI/Pipeline/", "def main():\n    s = vtkSphereSource(radius=2.0)\n    s.SetThetaResolution(8)\n    m = vtkPolyDataMapper()\n    m.SetInputConnection(s.GetOutputPort())\n    a = vtkActor()\n    a.SetMapper(m)\n    a.GetProperty().SetColor(1, 0, 0)\n"),
    ("https://host/Python/Window/", "import vtk\ndef make_window(a):\n    ren = vtk.vtkRenderer()\n    win = vtk.vtkRenderWindow()\n    win.AddRenderer(ren)\n    it = vtk.vtkRenderWindowInteractor()\n    it.SetRenderWindow(win)\n    it.Start()\nfor i in range(3):\n    vtkMath.Random()\n"),
    ("broken", "def ("),
]
CLASSES = [
    ("vtkSphereSource", "mod.Sources", "input", 0.8, "polygonal sphere creation", "", "", "vtkPolyData"), ("vtkPolyDataMapper", "mod.Core", "properties", 0.7, "", "", "vtkPolyData", ""),
    ("vtkActor", "mod.Core", "properties", 0.0, "actor display", "", "", ""), ("vtkRenderer", "mod.Core", "renderer", 0.9, None, "", "", ""), ("vtkRenderWindow", "mod.Core", "infrastructure", 0.9, None, "", "", ""),
    ("vtkRenderWindowInteractor", "mod.Core", "infrastructure", 0.9, None, "", "", ""), ("vtkMath", "mod.Math", None, 0.4, None, "", "", ""),
]
CLASS_SCHEMA = "class string, module string, role string, visibility_score double, action_phrase string, synopsis string, input_datatype string, output_datatype string"



# Snippets for the rules of static analysis, and by hand the lifecycles that they have.
RULES = [
    ("keywords", "a = vtk.vtkActor(mapper=m0)\nm = vtkPolyDataMapper()\nb = vtkActor(mapper=m, visibility=True)\ns = vtkSphereSource(center=(1, 2, 3), thetaResolution=9)\n"),
    ("results", "s = vtkSphereSource()\np = s.GetOutputPort()\nn = vtkMath.Random(1)\nvtkMath.Seed(n)\nx: int = vtkSphereSource()\n"),
    ("getter", "a = vtkActor()\np = a.GetProperty()\np.SetColor(1, 0, 0)\na.GetProperty().SetOpacity(0.5)\na.GetMapper().Update()\n"),
    ("attributes", "s = vtkSphereSource()\ns.radius = 2.5\ns.SetRadius(3)\nm = vtkPolyDataMapper()\na = vtkActor()\na.mapper = m\n"),
    ("blocks", "r = vtkRenderer()\nif ready:\n    r.ResetCamera()\nwhile busy:\n    r.Render()\nwith lock:\n    c = vtkCamera()\ntry:\n    c.Zoom(2)\nfinally:\n    r.Clear()\n"),
    ("loops", "r = vtkRenderer()\ns = vtkSphereSource()\nfor a in xs:\n    r.AddActor(a)\nfor i in range(3):\n    s.SetRadius(i)\n    r.Render()\nelse:\n    s.Update()\n"),
    ("last mapper", "m1 = vtkPolyDataMapper()\nm2 = vtkPolyDataMapper()\na = vtkActor()\na.SetMapper(m1)\na.SetMapper(m2)\n"),
    ("properties", "p = vtkProperty()\na = vtkActor()\na.SetProperty(p)\np.SetColor(1, 0, 0)\nf = vtkFollower()\nf.GetProperty().SetOpacity(1)\n"),
    ("rebound", "x = vtkSphereSource()\nx.SetRadius(1)\nx = vtkRenderer()\nx.Render()\n"),
    ("shared", "m = vtkPolyDataMapper()\na = vtkActor()\nb = vtkActor()\na.SetMapper(m)\nb.SetMapper(m)\nvtkPolyDataMapper.SetGlobal(1)\nvtkProperty.Reset()\nvtkVolume.Reset()\n"),
    ("infrastructure", "st = vtkInteractorStyleTrackball()\ni1 = vtkRenderWindowInteractor()\ni1.Start()\ni2 = vtkRenderWindowInteractor()\ni2.SetRenderWindow(w)\ni2.Initialize()\ni2.Start()\ni2.Start()\nw = vtkRenderWindow()\nw.SetSize(9, 9)\n"),
    ("classes", "class App:\n    def __init__(self):\n        self.m = vtkPolyDataMapper()\n        self.r = vtk.vtkRenderer()\n        self.a = vtkActor()\n    def run(self, x):\n        self.a.SetMapper(self.m)\n        self.a.x = 1\n        self.r.Render()\n        self.m.Update()\nclass Empty:\n    def go(self):\n        s = vtkSphereSource()\n"),
    ("scopes", "def make_it():\n    return vtkSphereSource()\ndef main():\n    s = make_it()\n    r = vtkRenderer()\n    unknown = vtkNothing()\nasync def later():\n    z = vtkSphereSource()\nif __name__ == '__main__':\n    main()\n"),
    ("chains", "a = vtkActor()\nb = a\nb.GetProperty().SetColor(1, 0, 0)\na.GetMapper().GetInput().Update()\na.Get().Go()\n"),
]
MORE_CLASSES = CLASSES + [(c, "mod.More", role, 0.5, "", "", "", "") for c, role in (("vtkProperty", "properties"), ("vtkCamera", "scene"), ("vtkInteractorStyleTrackball", "infrastructure"), ("vtkVolume", "properties"), ("vtkFollower", "properties"))]
PIPELINE, WINDOW = SNIPPETS[0][0], SNIPPETS[1][0]
BALL, MAPPER, ACTOR, RENDERER, WIN, INTERACTOR = "vtkSphereSource", "vtkPolyDataMapper", "vtkActor", "vtkRenderer", "vtkRenderWindow", "vtkRenderWindowInteractor"
PROPS, INFRA = "properties", "infrastructure"
#: example_id, chunk_no, member_no, variable, class, role, mapper, actor, methods, statements
LIFECYCLES = [
    (PIPELINE, 1, 0, "m", MAPPER, PROPS, None, "a", "SetInputConnection", 2), (PIPELINE, 1, 1, "a", ACTOR, PROPS, "m", None, "SetMapper", 3), (PIPELINE, 2, 0, "s", BALL, "input", None, None, "SetRadius,SetThetaResolution", 2),
    (WINDOW, 1, 0, "win", WIN, INFRA, None, None, "AddRenderer", 2), (WINDOW, 1, 1, "it", INTERACTOR, INFRA, None, None, "SetRenderWindow", 2), (WINDOW, 1, 2, "it", INTERACTOR, INFRA, None, None, "Start", 1),
    (WINDOW, 2, 0, "ren", RENDERER, "renderer", None, None, "", 1), (WINDOW, 3, 0, None, "vtkMath", "utility", None, None, "Random", 1),
    ("keywords", 1, 0, "a", ACTOR, PROPS, None, None, "", 1), ("keywords", 2, 0, "m", MAPPER, PROPS, None, "b", "", 1), ("keywords", 2, 1, "b", ACTOR, PROPS, "m", None, "SetMapper,SetVisibility", 1),
    ("keywords", 3, 0, "s", BALL, "input", None, None, "SetCenter,SetThetaresolution", 1),
    ("results", 1, 0, "s", BALL, "input", None, None, "", 1), ("results", 2, 0, None, "vtkMath", "utility", None, None, "Random,Seed", 2),
    ("getter", 1, 0, "a", ACTOR, PROPS, None, None, "", 3),
    ("attributes", 1, 0, "m", MAPPER, PROPS, None, "a", "", 1), ("attributes", 1, 1, "a", ACTOR, PROPS, "m", None, "SetMapper", 2), ("attributes", 2, 0, "s", BALL, "input", None, None, "SetRadius", 3),
    ("blocks", 1, 0, "r", RENDERER, "renderer", None, None, "ResetCamera,Render,Clear", 4), ("blocks", 2, 0, "c", "vtkCamera", "scene", None, None, "Zoom", 2),
    ("loops", 1, 0, "r", RENDERER, "renderer", None, None, "Render", 3), ("loops", 2, 0, "s", BALL, "input", None, None, "SetRadius", 2),
    ("last mapper", 1, 0, "m2", MAPPER, PROPS, None, "a", "", 1), ("last mapper", 1, 1, "a", ACTOR, PROPS, "m2", None, "SetMapper", 3), ("last mapper", 2, 0, "m1", MAPPER, PROPS, None, "a", "", 1),
    ("properties", 1, 0, "a", ACTOR, PROPS, None, None, "SetProperty", 4), ("properties", 2, 0, "f", "vtkFollower", PROPS, None, None, "", 2),
    ("rebound", 1, 0, "x", RENDERER, "renderer", None, None, "SetRadius,Render", 4),
    ("shared", 1, 0, "m", MAPPER, PROPS, None, "b", "", 1), ("shared", 1, 1, "a", ACTOR, PROPS, "m", None, "SetMapper", 2), ("shared", 2, 0, "m", MAPPER, PROPS, None, "b", "", 1),
    ("shared", 2, 1, "b", ACTOR, PROPS, "m", None, "SetMapper", 2), ("shared", 3, 0, None, "vtkVolume", PROPS, None, None, "Reset", 1),
    ("infrastructure", 1, 0, "w", WIN, INFRA, None, None, "SetSize", 2), ("infrastructure", 1, 1, "i2", INTERACTOR, INFRA, None, None, "SetRenderWindow,Initialize", 3),
    ("infrastructure", 1, 2, "st", "vtkInteractorStyleTrackball", INFRA, None, None, "", 1), ("infrastructure", 1, 3, "i2", INTERACTOR, INFRA, None, None, "Start", 1),
    ("classes", 1, 0, "self.m", MAPPER, PROPS, None, "self.a", "Update", 2), ("classes", 1, 1, "self.a", ACTOR, PROPS, "self.m", None, "SetMapper", 2), ("classes", 2, 0, "self.r", RENDERER, "renderer", None, None, "", 1),
    ("scopes", 1, 0, "r", RENDERER, "renderer", None, None, "", 1), ("scopes", 2, 0, "z", BALL, "input", None, None, "", 1),
    ("chains", 1, 0, "a", ACTOR, PROPS, None, None, "", 1),
]


def typed_values(rows: list[tuple], **columns: str) -> str:
    """SELECT of literal rows, with types."""
    casts = ", ".join(f"CAST({n} AS {kind}) AS {n}" for n, kind in columns.items())
    return f"SELECT {casts} FROM {sql_values(rows, *columns)}"


def part_sources(spark: SparkSession, d: str, rows: list[tuple]) -> DataFrame:
    """An example a part, its id with the part's number: in turn one of the snippets, with the part's name in a comment, in a string and as an unknown variable's value at its end."""
    p = t(spark, d, "part")
    one = F.element_at(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(c).alias("code")) for i, c in rows]), (F.pmod("p_partkey", F.lit(len(rows))) + 1).cast("int"))
    made = F.concat(F.lit("# "), "p_name", F.lit("\n"), F.col("s.code"), F.lit("\nlabel = '"), "p_name", F.lit("'\n"))
    named = F.concat(F.regexp_replace("s.id", "/$", ""), F.lit("#"), F.col("p_partkey").cast("string"), F.when(F.endswith("s.id", F.lit("/")), F.lit("/")).otherwise(F.lit("")))
    return p.withColumn("s", one).select(named.alias("example_id"), made.alias("code"))


def part_lifecycles() -> str:
    rows = SNIPPETS + RULES
    lives = typed_values(LIFECYCLES, example_id="VARCHAR", chunk_no="INT", member_no="INT", variable="VARCHAR", **{"class": "VARCHAR"}, role="VARCHAR", mapper="VARCHAR", actor="VARCHAR", methods="VARCHAR", statements="BIGINT")
    numbered = sql_values([(i, r[0]) for i, r in enumerate(rows)], "which", "of")
    return f"SELECT l.* REPLACE (regexp_replace(example_id, '/$', '') || '#' || p_partkey || CASE WHEN ends_with(example_id, '/') THEN '/' ELSE '' END AS example_id) FROM part JOIN {numbered} ON p_partkey % {len(rows)} = which JOIN ({lives}) l ON l.example_id = v.of"


@query(part_lifecycles())
def code_lifecycles(spark: SparkSession, d: str) -> DataFrame:
    return code_chunks.lifecycles(part_sources(spark, d, SNIPPETS + RULES), values(spark, MORE_CLASSES, CLASS_SCHEMA))


#: chunk_no, chunk_id, action_phrase, synopsis, role, visibility_score, input_datatype, output_datatype, content, variable_name, vtk_class_names, methods, queries, is_pythonic
CHUNKS = [
    (1, "Pipeline_chunk_1", "Poly data mapper → Actor display → Property", "Poly data mapper with input connection set to s.GetOutputPort() → Actor display with mapper set to m → Property", PROPS, round((0.7 + 0.5 + 0.5) / 3, 6), "vtkPolyData", ACTOR,
     "from mod.Core import vtkActor, vtkPolyDataMapper\n\nm = vtkPolyDataMapper()\nm.SetInputConnection(s.GetOutputPort())\na = vtkActor()\na.SetMapper(m)\na.GetProperty().SetColor(1, 0, 0)",
     "m, a", "vtkPolyDataMapper,vtkActor,vtkProperty", "SetInputConnection|SetMapper|",
     "How do you use poly data mapper?\nHow do you set the input connection of a poly data mapper?\nHow do you display an actor?\nHow do you set the mapper of an actor display?\nHow do you use property?", True),
    (2, "Pipeline_chunk_2", "Polygonal sphere creation", "Polygonal sphere creation with radius set to 2.0, theta resolution set to 8", "input", 0.8, "", "vtkPolyData",
     "from mod.Sources import vtkSphereSource\n\ns = vtkSphereSource(radius=2.0)\ns.SetThetaResolution(8)", "s", BALL, "SetRadius,SetThetaResolution",
     "How do you create a polygonal sphere?\nHow do you set the radius of a polygonal sphere creation?\nHow do you set the theta resolution of a polygonal sphere creation?", True),
    (1, "Window_chunk_1", "Render window → Render window interactor", "Render window with renderer added → Render window interactor with render window set to win", INFRA, 0.9, "vtkRenderer", "",
     "import vtkmodules.vtkRenderingOpenGL2\nimport vtkmodules.vtkInteractionStyle\nfrom mod.Core import vtkRenderWindow, vtkRenderWindowInteractor\n\nwin = vtkRenderWindow()\nwin.AddRenderer(ren)\nit = vtkRenderWindowInteractor()\nit.SetRenderWindow(win)\nit.Start()",
     "win, it, it", "vtkRenderWindow,vtkRenderWindowInteractor", "AddRenderer|SetRenderWindow,Start",
     "How do you use render window?\nHow do you add a renderer to a render window?\nHow do you use render window interactor?\nHow do you set the render window of a render window interactor?\nhow to make a window", False),
    (2, "Window_chunk_2", "Renderer", "Renderer", "renderer", 0.9, ACTOR, RENDERER, "from mod.Core import vtkRenderer\n\nren = vtkRenderer()", "ren", RENDERER, "", "How do you use renderer?\nhow to make a window", False),
    (3, "Window_chunk_3", "Math", "Math", "utility", 0.4, "", "", "from mod.Math import vtkMath\n\nvtkMath.Random()", "", "vtkMath", "Random", "How do you use math?\nHow do you random a math?", False),
]


CHUNKS_SQL = typed_values(CHUNKS, chunk_no="INT", chunk_id="VARCHAR", action_phrase="VARCHAR", synopsis="VARCHAR", role="VARCHAR", visibility_score="DOUBLE", input_datatype="VARCHAR", output_datatype="VARCHAR", content="VARCHAR", variable_name="VARCHAR", vtk_class_names="VARCHAR", methods="VARCHAR", queries="VARCHAR", is_pythonic="BOOLEAN")


@query(f"SELECT c.* REPLACE (replace(chunk_id, '_chunk_', '#' || p_partkey || '_chunk_') AS chunk_id) FROM part JOIN ({CHUNKS_SQL}) c ON p_partkey % {len(SNIPPETS)} = CASE WHEN starts_with(chunk_id, 'Pipeline') THEN 0 ELSE 1 END")
def code_chunks_of_snippets(spark: SparkSession, d: str) -> DataFrame:
    chunks = code_chunks.chunk_code(part_sources(spark, d, SNIPPETS), values(spark, CLASSES, CLASS_SCHEMA))
    methods = F.array_join(F.transform("vtk_classes", lambda c: F.array_join(c["methods"], ",")), "|")
    shown = chunks.select("chunk_no", "chunk_id", "action_phrase", "synopsis", "role", F.round("visibility_score", 6).alias("visibility_score"), "input_datatype", "output_datatype", "content", "variable_name", F.array_join("vtk_class_names", ",").alias("vtk_class_names"), methods.alias("methods"), F.array_join("queries", "\n").alias("queries"), "is_pythonic")
    return shown
