"""Lexical search: per-catalog text index tables, weighted BM25, LIKE fallback,
post-filters and the fused/merged search over all catalogs.

Plan shape (the part that matters at scale):
  * the index is three tables: postings (catalog, doc, field, term, tf, len),
    term document frequencies (catalog, term, df) and catalog stats (N, avgdl);
    they and the postings by impact are made from records whose terms are
    counted once (``postings.py``);
  * a search batch is a small table of (query, catalog, term); blocks are
    filtered by its terms where they lie and never shuffled whole; only
    matching postings reach the aggregation by (query, catalog, doc);
  * top-n per (query, catalog) is a row_number filter, which Spark plans with a
    partial per-partition limit before the shuffle (WindowGroupLimit).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirador.functions import lookups as L
from mirador.functions.columns import fts_tokens
from mirador.operators import postings
from mirador.operators.text import expand_query
from mirador.session import materialize

FIELDS = ("title", "description", "organization", "tags")

# Fixed parameter: the languages and acronym pack each stand-in catalog uses.
PACK_OF = "CASE {} % 9 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(L.ACRONYMS)) + " ELSE '' END"
CATALOG_LANG_SQL = f"""
SELECT id AS catalog_id, CASE WHEN pos % 2 = 0 THEN 'es' ELSE 'en' END AS language,
 {PACK_OF.format('pos')} AS country_code FROM v_catalogs"""


def index_rows(datasets: DataFrame) -> DataFrame:
    """The indexed text of each record: null fields as empty strings, tags joined by space."""
    return datasets.select(
        "id", "catalog_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("organization", F.lit("")).alias("organization"),
        F.coalesce(F.array_join("tags", " "), F.lit("")).alias("tags"))


def stem_column(tokens: Column, stem) -> Column:
    """Apply a per-word stemmer to a token array (Arrow-batched pandas UDF);
    ``stem=None`` keeps the tokens (the default, as no stemmer ships offline)."""
    if stem is None:
        return tokens

    @F.pandas_udf("array<string>")
    def _stem(col: pd.Series) -> pd.Series:
        cache: dict[str, str] = {}

        def one(words):
            if words is None:
                return None
            out = []
            for w in words:
                if w not in cache:
                    cache[w] = stem(w)
                out.append(cache[w])
            return out
        return col.map(one)
    return _stem(tokens)


def token_table(datasets: DataFrame, stem=None) -> DataFrame:
    """(catalog_id, id, len, and packed: the record's distinct terms, with an int per field): the
    one tokenisation pass."""
    return postings.count_records(index_rows(datasets), FIELDS, stem)


def count_terms(toks: DataFrame) -> DataFrame:
    """(catalog_id, id, len, term, tf: an int per field) of every row by itself: nothing is shuffled."""
    return postings.term_rows(toks, len(FIELDS))


def fts_terms(toks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The records whose (catalog, id) is theirs alone, as counted, and the terms of those that share
    it (None, if none do), summed by length, each with the number of its ``records``."""
    key = F.xxhash64("catalog_id", "id")
    shared = toks.groupBy(key.alias("_k")).count().where("count > 1").select("_k")
    if shared.limit(1).count() == 0:
        return toks, None
    shared, keyed = materialize(shared), toks.withColumn("_k", key)
    again = count_terms(keyed.join(shared, "_k", "left_semi")).groupBy("catalog_id", "id", "len", "term").agg(
        F.array(*[F.sum(F.col("tf")[k]).cast("int") for k in range(len(FIELDS))]).alias("tf"), F.count(F.lit(1)).alias("records"))
    return keyed.join(shared, "_k", "left_anti").drop("_k"), again


def fts_postings(terms: tuple[DataFrame, DataFrame | None]) -> DataFrame:
    """(catalog, doc, field, term, len, tf), a row per field that holds the term."""
    once, again = terms
    rows = count_terms(once) if again is None else count_terms(once).unionByName(again.drop("records"))
    names = F.array(*[F.lit(f) for f in FIELDS])
    return (rows.select("catalog_id", "id", "len", "term", F.posexplode("tf").alias("pos", "tf")).where("tf > 0")
            .select("catalog_id", "id", F.get(names, F.col("pos")).alias("field"), "term", "len", F.col("tf").cast("bigint").alias("tf")))


def fts_term_df(toks: DataFrame) -> DataFrame:
    """Documents per (catalog, term): a record's terms are distinct in its row, and are counted per
    slice of an Arrow batch before the shuffle, so a very common term is merged from small counts; few of
    the others would merge in a second count before it."""
    return postings.term_counts(toks).repartition("catalog_id", "term").groupBy("catalog_id", "term").agg(F.sum("n").alias("df"))


def fts_stats(toks: DataFrame) -> DataFrame:
    """Documents and mean document length per catalog (all records, empty ones too)."""
    return toks.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avgdl"))


def fts_build(datasets: DataFrame, stem=None) -> dict[str, DataFrame]:
    """Index tables for all catalogs at once (statistics grouped by catalog)."""
    toks = token_table(datasets, stem)
    terms = fts_terms(toks)
    return {"terms": terms, "postings": fts_postings(terms), "term_df": fts_term_df(toks), "stats": fts_stats(toks)}


def query_literal(queries: list[tuple[int, str]]) -> Column:
    return F.array(*[F.struct(F.lit(qid).alias("query_id"), F.lit(q).alias("query")) for qid, q in queries])


def query_terms(queries: list[tuple[int, str]], catalog_lang: DataFrame, stem=None) -> DataFrame:
    """(query_id, catalog_id, term): each query expanded with its catalog's packs,
    then tokenised like the index. The (parameter-sized) query list is a literal
    exploded on each catalog row, so no join builds the pairs."""
    cq = catalog_lang.select("catalog_id", "language", "country_code",
                             F.explode(query_literal(queries)).alias("q"))
    exp = cq.select("catalog_id", F.col("q.query_id").alias("query_id"),
                    expand_query(F.col("q.query"), F.col("language"), F.col("country_code"))
                    .alias("expanded"))
    terms = F.array_distinct(stem_column(fts_tokens(F.col("expanded")), stem))
    return exp.select("query_id", "catalog_id", F.explode(terms).alias("term"))


def bm25_part(tf: Column) -> Column:
    """BM25 of a term that stands ``tf`` times, from a row with len, df and the catalog's stats."""
    k, b = L.BM25_K, L.BM25_B
    idf = F.log10((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return idf * (tf * (k + 1) / (tf + k * (1 - b + b * (F.col("len") / F.col("avgdl")))))


def score_part() -> Column:
    """One posting's weighted BM25 part, from its row with df and the catalog's stats."""
    weight = F.lit(0.0)
    for f, w in L.FIELD_WEIGHTS.items():
        weight = F.when(F.col("field") == f, F.lit(w)).otherwise(weight)
    return bm25_part(F.col("tf")) * weight


def bm25_scores(index: dict[str, DataFrame], qterms: DataFrame) -> DataFrame:
    """Weighted BM25 per (query, catalog, doc), scores > 0 only."""
    keys = ["catalog_id", "term"]
    # term statistics of the query terms only (semi join against the small side)
    dfq = index["term_df"].join(qterms.select(*keys).distinct(), keys, "left_semi")
    hits = index["postings"].join(qterms, keys)
    hits = hits.join(dfq, keys).join(index["stats"], "catalog_id")
    return (hits.groupBy("query_id", "catalog_id", "id").agg(F.sum(score_part()).alias("score"))
            .where(F.col("score") > 0))


def top_n(df: DataFrame, keys: list[str], n: int, score: str = "score") -> DataFrame:
    """Top n rows per key by score (rounded to 9 decimals so ties are stable), then id."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round(score, 9)), F.asc("id"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def bm25_search(index, qterms, limit: int = L.DEFAULT_FTS_LIMIT) -> DataFrame:
    return top_n(bm25_scores(index, qterms), ["query_id", "catalog_id"], limit)


# ------------------------------------------------------------------ postings by impact
BLOCK_POSTINGS = 128           # postings a block, at most
TERM_BUCKETS = 64              # folders of the postings


def term_bucket(catalog: Column, term: Column) -> Column:
    return F.pmod(postings.place_of(catalog, term), F.lit(TERM_BUCKETS)).cast("int")


SLICE_POSTINGS = 1_000_000     # postings that a task sorts, about
SALT_POSTINGS = 100_000        # a term of more is dealt to several tasks


def dealt_postings(index: dict[str, DataFrame], slices: int, common: dict[str, dict[str, int]]) -> DataFrame:
    """Postings without the idf, a packed row per Arrow batch and slice of a folder (``part``);
    ``common`` has the df of the terms that are cut by document ({term: {catalog: df}})."""
    parts = {t: {c: -(-n // SALT_POSTINGS) for c, n in of.items()} for t, of in common.items()}
    dealer = postings.Dealer(TERM_BUCKETS, slices, parts, [L.FIELD_WEIGHTS.get(f, 0.0) for f in FIELDS])

    def ready(rows: DataFrame, *last: str) -> DataFrame:
        return rows.join(index["stats"], "catalog_id").select(
            "catalog_id", "id", "len", F.xxhash64("id").alias("id_hash"), F.col("n_docs").cast("bigint").alias("n_docs"), "avgdl", *last)

    once, again = index["terms"]
    dealt = ready(once, "terms", "sizes", "tf").mapInArrow(dealer.records, postings.DEALT_DDL)
    if again is None:
        return dealt
    return dealt.unionByName(ready(again, "term", "tf", "records").mapInArrow(dealer.term_rows, postings.DEALT_DDL))


def write_impacts(index: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Postings by (catalog, term), greatest impacts (what a term adds to a document's score, over
    its fields) first, in blocks; in folders by a hash of both. A block is a row with its greatest
    and least impact.

    A folder's terms are dealt to so many slices that a task sorts about ``SLICE_POSTINGS``; a
    very common term is cut by document into parts, each in its own slice. A block is what a part
    holds of ``BLOCK_POSTINGS`` consecutive postings. The postings cross the shuffle once, packed
    by slice; a slice holds all postings of its terms and so knows their df. Only those of
    very common terms (a few per slice at most) are looked up before and go to the tasks."""
    df = index["term_df"]
    spark = df.sparkSession
    total = df.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    slices = max(1, -(-total // (TERM_BUCKETS * SLICE_POSTINGS)))
    common: dict[str, dict[str, int]] = {}
    for r in df.where(F.col("catalog_id").isNotNull() & (F.col("df") > SALT_POSTINGS)).collect():
        common.setdefault(r["term"], {})[r["catalog_id"]] = r["df"]
    (dealt_postings(index, slices, common).repartitionById(TERM_BUCKETS * slices, F.col("part").cast("int"))
     .mapInArrow(postings.blocks(slices, BLOCK_POSTINGS, common, index["terms"][1] is not None), postings.BLOCKS_DDL)
     .write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings"))
    return read_impacts(spark, path)


def read_impacts(spark, path: str) -> dict[str, DataFrame]:
    rows = spark.read.parquet(f"{path}/postings")
    return {"impacts": rows.drop("bound", "low", "n"), "blocks": rows.drop("ids", "id_sizes", "impacts")}


def useful_blocks(blocks: DataFrame, qterms: DataFrame, limit: int) -> DataFrame:
    """The blocks of the query terms that can hold one of the ``limit`` best documents.

    The least impact of a term's first blocks that hold ``limit`` postings is a lower bound of a
    query's ``limit``-th score; the greatest over its terms is the threshold. A document in a
    block scores at most the block's bound and the other terms' greatest impacts; below the
    threshold the block is left out. Documents at or above it lose no block, and at least
    ``limit`` of them are, so the result is exact."""
    key = ["query_id", "catalog_id"]
    mine = blocks.join(qterms, ["catalog_id", "term"])
    down = Window.partitionBy(*key, "term").orderBy(F.desc("bound"), F.desc("low"), "block")
    seen = mine.withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    terms = seen.groupBy(*key, "term").agg(F.max("bound").alias("own"), F.max(F.when(F.col("upto") >= limit, F.col("low"))).alias("kth"))
    sums = terms.groupBy(*key).agg(F.sum("own").alias("most"), F.coalesce(F.max("kth"), F.lit(0.0)).alias("threshold"))
    j = mine.join(sums, key).join(terms.select(*key, "term", "own"), [*key, "term"])
    reach = F.col("bound") + F.col("most") - F.col("own") + F.lit(1e-6)
    return j.where(reach >= F.col("threshold")).select(*key, "term", "block")


FEW_TERMS = 10_000             # distinct terms of a batch of queries that a filter lists, at most


def bm25_topk(index: dict[str, DataFrame], qterms: DataFrame, limit: int = L.DEFAULT_FTS_LIMIT) -> DataFrame:
    """The ``limit`` best documents per (query, catalog), from the blocks that can hold them. Only
    the folders of the query's terms are read (a partition filter), and of them only the terms
    asked for go on to the joins; postings are unpacked after them."""
    terms = qterms.withColumn("bucket", term_bucket(F.col("catalog_id"), F.col("term")))
    buckets = [r[0] for r in terms.select("bucket").distinct().collect()]       # at most TERM_BUCKETS numbers
    here = F.col("bucket").isin(*buckets) if buckets else F.lit(False)
    asked = [r[0] for r in terms.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    if len(asked) <= FEW_TERMS:
        here = here & F.col("term").isin(*asked)
    wanted = useful_blocks(index["blocks"].where(here), qterms, limit)
    hits = index["impacts"].where(here).join(wanted, ["catalog_id", "term", "block"])
    scored = postings.unpacked(hits, ["query_id", "catalog_id"]).groupBy("query_id", "catalog_id", "id").agg(F.sum("impact").alias("score"))
    return top_n(scored, ["query_id", "catalog_id"], limit)


LIKE_ESCAPE = "\x01"
FEW_CATALOGS = 10_000          # rows of (catalog, its queries) that a join broadcasts, at most


def like_terms(query: str) -> list[str]:
    return [t for t in query.lower().split() if len(t) > 1]


def _like_any(terms: list[str]) -> Column:
    cond = F.lit(False)
    for t in terms:
        # no default escape: an escape character that a word cannot hold leaves "\\" as it is
        pat = F.lit(f"%{t.replace(LIKE_ESCAPE, '')}%")
        for f in FIELDS:
            cond = cond | F.like(F.col(f), pat, F.lit(LIKE_ESCAPE))
    return cond


def like_fallback(datasets: DataFrame, queries: list[tuple[int, str]],
                  limit: int = L.DEFAULT_FTS_LIMIT, pairs: DataFrame | None = None) -> DataFrame:
    """Rows where any query word (> 1 letter) is a substring of any field; score =
    number of words; the first ``limit`` per (query, catalog) by id.

    Each record is tested against the (parameter-sized) query list in one
    projection and only matches are emitted; no record x query product. With ``pairs``
    (query_id, catalog_id) only those are looked for: a catalog without a pair is not read
    further, and a record is tested for its catalog's queries only.
    """
    # lowered once here, not at each of a query's words
    rows = index_rows(datasets).select("id", "catalog_id", *[F.lower(f).alias(f) for f in FIELDS])
    asked = F.lit(True)
    if pairs is not None:
        wanted = materialize(pairs.groupBy("catalog_id").agg(F.collect_set("query_id").alias("asked")))    # the queries at most
        few = wanted.limit(FEW_CATALOGS + 1).count() <= FEW_CATALOGS          # then the texts are not shuffled
        rows = rows.join(F.broadcast(wanted) if few else wanted, "catalog_id")
    matched = F.array_compact(F.array(*[
        F.when((F.array_contains("asked", qid) if pairs is not None else asked) & _like_any(like_terms(q)),
               F.struct(F.lit(qid).alias("query_id"), F.lit(float(len(like_terms(q)))).alias("score")))
        for qid, q in queries if like_terms(q)] or [F.lit(None).cast("struct<query_id:int,score:double>")]))
    hits = rows.select("id", "catalog_id", F.explode(matched).alias("m")) \
               .select(F.col("m.query_id").alias("query_id"), "catalog_id", "id", F.col("m.score").alias("score"))
    w = Window.partitionBy("query_id", "catalog_id").orderBy("id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def fts_search(datasets, index, qterms, queries, limit: int, catalogs: DataFrame | None = None) -> DataFrame:
    """BM25 per (query, catalog); the LIKE fallback for the pairs where it finds nothing.
    ``catalogs`` (catalog_id) are those searched (default: all that have records)."""
    lex = bm25_topk(index, qterms, limit) if "impacts" in index else bm25_search(index, qterms, limit)
    known = (index["stats"] if catalogs is None else catalogs).select("catalog_id")
    pairs = known.withColumn("query_id", F.explode(F.array(*[F.lit(qid) for qid, _ in queries])))
    lex = materialize(lex)                                       # read twice; ``limit`` rows per pair at most
    empty = pairs.join(lex.select("query_id", "catalog_id").distinct(), ["query_id", "catalog_id"], "left_anti")
    return lex.unionByName(like_fallback(datasets, queries, limit, empty))


# ------------------------------------------------------------------ post-filters
def filter_organization(df: DataFrame, org: str | None) -> DataFrame:
    if not org:
        return df
    return df.where(F.col("organization").isNotNull()
                    & F.lower(F.col("organization")).contains(org.lower()))


def filter_format(df: DataFrame, resources: DataFrame, fmt: str | None) -> DataFrame:
    """Any resource with an equal format (case-insensitive): a semi join."""
    if not fmt:
        return df
    hit = resources.where(F.lower(F.col("format")) == fmt.lower()).select(F.col("dataset_id").alias("id"))
    return df.join(hit, "id", "left_semi")


def filter_tags_all(df: DataFrame, tags: list[str] | None) -> DataFrame:
    if not tags:
        return df
    req = F.array(*[F.lit(t.lower()) for t in tags])
    have = F.transform(F.coalesce(F.col("tags"), F.array().cast("array<string>")), lambda t: F.lower(t))
    return df.where(F.size(F.array_except(req, have)) == 0)


def merge_over_catalogs(per_catalog: DataFrame) -> DataFrame:
    """Best score of each id over the per-catalog lists."""
    return per_catalog.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def in_catalog(df: DataFrame, catalog: str | None) -> DataFrame:
    """Rows of one catalog, if one is named: put on the query terms, the vectors and the records,
    so postings, vectors and texts of the others are not read."""
    return df if catalog is None else df.where(F.col("catalog_id") == catalog)


def hybrid_search(per_catalog: DataFrame, datasets: DataFrame, resources: DataFrame,
                  limit: int = L.DEFAULT_SEARCH_LIMIT, organization: str | None = None,
                  fmt: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Merge per-catalog lists (already over-fetched), resolve, post-filter, take limit."""
    merged = merge_over_catalogs(per_catalog)
    resolved = merged.join(datasets.select("id", "catalog_id", "title", "organization", "tags"), "id")
    resolved = filter_organization(resolved, organization)
    resolved = filter_format(resolved, resources, fmt)
    resolved = filter_tags_all(resolved, tags)
    return top_n(resolved, ["query_id"], limit)
