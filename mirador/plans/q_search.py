"""Search operators: normalisation, expansion, index, BM25, fallback, filters,
hybrid search, document text, lookups and listing."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirador.fixtures import load_tables, register_views
from mirador.functions import lookups as L
from mirador.functions.columns import normalize_text
from mirador.operators import documents, ranking, search, text
from mirador.plans import pipeline
from mirador.plans.oracles import oracle
from mirador.plans.registry import query
from mirador.plans.sqlparts import (SCORES_CTES, expand_acronyms, expand_synonyms, normalize, tokens,
                                    values_table)
from mirador.session import scratch_path, written_folder, written_table
from mirador.sources import records, stores

# Fixed parameter: the batch of search queries run against every catalog.
SEARCH_QUERIES = [
    (1, "the"),
    (2, "Qué datos"),
    (3, "orre tion"),
    (4, "Presupuesto salud"),
    (5, "INDEC población"),
    (6, "budget health"),
    (7, "attion thing"),
    (8, "Org topic"),
    (9, "opi"),
    (10, "nterti zzqx"),
]
FTS_VIEWS = ("v_datasets", "v_catalogs")


def catalog_lang(spark, sf):
    register_views(spark, sf, ("v_catalogs",))
    return spark.sql(search.CATALOG_LANG_SQL)


def query_pairs(spark, sf):
    return catalog_lang(spark, sf).select(
        "catalog_id", "language", "country_code", F.explode(search.query_literal(SEARCH_QUERIES)).alias("q")) \
        .select("catalog_id", "language", "country_code", F.col("q.query_id").alias("query_id"),
                F.col("q.query").alias("query"))


CQ_SQL = f"""cl AS ({search.CATALOG_LANG_SQL.strip()}),
q AS {values_table(SEARCH_QUERIES)},
cq AS (SELECT cl.catalog_id, cl.language, cl.country_code, q.query_id, q.query FROM cl CROSS JOIN q)"""


# ------------------------------------------------------------------ normalise / expand
@query("normalize_text")
def q_normalize_text(spark, sf):
    register_views(spark, sf, ())
    docs = spark.table("documents")
    return docs.select("doc_id", normalize_text(F.col("text")).alias("normalized"))


oracle("normalize_text", f"SELECT doc_id, {normalize('text')} AS normalized FROM documents")


# Each turn of a conversation ends in a word of the packs, chosen by its number, so that all packs
# occur; its pack and language follow from the conversation.
PACK_WORDS = sorted({w for pack in L.ACRONYMS.values() for w in pack} | {w for pack in L.SYNONYMS.values() for w in pack})
WORD_NO = f"(conv_id * 7 + turn) % {len(PACK_WORDS)}"
TURNS_SQL = f"""
SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'es' ELSE 'en' END AS language, {search.PACK_OF.format('conv_id')} AS country_code,
 {{text}} AS text FROM conversations"""


def turns(spark, sf):
    load_tables(spark, sf, ("conversations",))
    word = F.element_at(F.array(*[F.lit(w) for w in PACK_WORDS]), (F.expr(WORD_NO) + 1).cast("int"))
    t = spark.sql(TURNS_SQL.format(text="text"))
    return t.withColumn("text", F.concat_ws(" ", "text", word))


_WORDS_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in PACK_WORDS) + "]"
TURNS_CTE = "turns AS (" + TURNS_SQL.strip().format(text=f"concat_ws(' ', text, ({_WORDS_SQL})[CAST({WORD_NO} + 1 AS INTEGER)])") + ")"


@query("expand_acronyms")
def q_expand_acronyms(spark, sf):
    return turns(spark, sf).select(
        "conv_id", "turn", text.expand_acronyms(normalize_text(F.col("text")), F.col("country_code")).alias("expanded"))


oracle("expand_acronyms", f"""WITH {TURNS_CTE}
SELECT conv_id, turn, {expand_acronyms(normalize('text'), 'country_code')} AS expanded FROM turns""")


@query("expand_synonyms")
def q_expand_synonyms(spark, sf):
    return turns(spark, sf).select(
        "conv_id", "turn", text.expand_synonyms(normalize_text(F.col("text")), F.col("language")).alias("expanded"))


oracle("expand_synonyms", f"""WITH {TURNS_CTE}
SELECT conv_id, turn, {expand_synonyms(normalize('text'), 'language')} AS expanded FROM turns""")


@query("expand_query")
def q_expand_query(spark, sf):
    return turns(spark, sf).select(
        "conv_id", "turn", text.expand_query(F.col("text"), F.col("language"), F.col("country_code")).alias("expanded"))


oracle("expand_query", f"""WITH {TURNS_CTE},
e AS (SELECT conv_id, turn, list_filter(string_split_regex({expand_synonyms(expand_acronyms(normalize('text'), 'country_code'), 'language')}, '\\s+'), lambda t: t <> '') AS toks FROM turns)
SELECT conv_id, turn, array_to_string(list_filter(toks, lambda x, i: list_position(toks, x) = i), ' ') AS expanded FROM e""")

# ------------------------------------------------------------------ index and BM25


def index_for(spark, sf):
    """The text index tables, built once per input folder and kept in the shared folder."""
    key = sf.rstrip("/")
    toks = written_table(spark, ("fts", "tokens", key),
                         lambda: search.token_table(records.datasets(spark, sf)))
    return {"postings": written_table(spark, ("fts", "postings", key), lambda: search.fts_postings(search.fts_terms(toks))),
            "term_df": written_table(spark, ("fts", "term_df", key), lambda: search.fts_term_df(toks)),
            "stats": written_table(spark, ("fts", "stats", key), lambda: search.fts_stats(toks))}


@query("fts_build")
def q_fts_build(spark, sf):
    idx = index_for(spark, sf)
    return (idx["postings"].join(idx["term_df"], ["catalog_id", "term"])
            .join(idx["stats"], "catalog_id")
            .select("catalog_id", "id", "field", "term", F.col("tf").cast("bigint").alias("tf"),
                    F.col("len").cast("bigint").alias("len"), F.col("df").cast("bigint").alias("df"),
                    F.col("n_docs").cast("bigint").alias("n_docs"), F.round("avgdl", 6).alias("avgdl")))


INDEX_SQL = f"""docs AS (SELECT id, catalog_id, coalesce(title, '') AS title, coalesce(description, '') AS description,
  coalesce(organization, '') AS organization, coalesce(tags_text, '') AS tags FROM v_datasets),
tok AS (SELECT id, catalog_id, {tokens('title')} AS t_title, {tokens('description')} AS t_description,
  {tokens('organization')} AS t_organization, {tokens('tags')} AS t_tags FROM docs),
lens AS (SELECT id, catalog_id, len(t_title) + len(t_description) + len(t_organization) + len(t_tags) AS len FROM tok),
post AS (SELECT catalog_id, id, 'title' AS field, unnest(t_title) AS term FROM tok
  UNION ALL SELECT catalog_id, id, 'description', unnest(t_description) FROM tok
  UNION ALL SELECT catalog_id, id, 'organization', unnest(t_organization) FROM tok
  UNION ALL SELECT catalog_id, id, 'tags', unnest(t_tags) FROM tok),
tfs AS (SELECT catalog_id, id, field, term, count(*) AS tf FROM post GROUP BY catalog_id, id, field, term),
dfs AS (SELECT catalog_id, term, count(DISTINCT id) AS df FROM post GROUP BY catalog_id, term),
st AS (SELECT catalog_id, count(*) AS n_docs, avg(len) AS avgdl FROM lens GROUP BY catalog_id)"""

oracle("fts_build", f"""WITH {INDEX_SQL}
SELECT tfs.catalog_id, tfs.id, field, tfs.term, CAST(tf AS BIGINT) AS tf, CAST(lens.len AS BIGINT) AS len,
 CAST(df AS BIGINT) AS df, CAST(n_docs AS BIGINT) AS n_docs, round(avgdl, 6) AS avgdl
FROM tfs JOIN dfs ON tfs.catalog_id = dfs.catalog_id AND tfs.term = dfs.term
 JOIN lens ON tfs.id = lens.id JOIN st ON tfs.catalog_id = st.catalog_id""", "v_datasets")


def qterms_for(spark, sf):
    return search.query_terms(SEARCH_QUERIES, catalog_lang(spark, sf))


def _weight_sql():
    return "CASE field " + " ".join(f"WHEN '{f}' THEN CAST({w!r} AS DOUBLE)" for f, w in L.FIELD_WEIGHTS.items()) \
        + " ELSE CAST(0.0 AS DOUBLE) END"


QT_SQL = f"""{CQ_SQL},
ex AS (SELECT query_id, catalog_id, {expand_synonyms(expand_acronyms(normalize('query'), 'country_code'), 'language')} AS expanded FROM cq),
qt AS (SELECT DISTINCT query_id, catalog_id, unnest({tokens('expanded')}) AS term FROM ex)"""

BM25_SQL = f"""{QT_SQL}, {INDEX_SQL},
hits AS (SELECT qt.query_id, tfs.catalog_id, tfs.id, tfs.field, tfs.tf, dfs.df, lens.len, st.n_docs, st.avgdl
  FROM qt JOIN tfs ON qt.catalog_id = tfs.catalog_id AND qt.term = tfs.term
  JOIN dfs ON dfs.catalog_id = tfs.catalog_id AND dfs.term = tfs.term
  JOIN lens ON lens.id = tfs.id JOIN st ON st.catalog_id = tfs.catalog_id),
sc AS (SELECT query_id, catalog_id, id,
  sum(log10((n_docs - df + 0.5) / (df + 0.5) + 1) * (tf * ({L.BM25_K} + 1) / (tf + {L.BM25_K} * (1 - {L.BM25_B} + {L.BM25_B} * (len / avgdl)))) * {_weight_sql()}) AS score
  FROM hits GROUP BY query_id, catalog_id, id HAVING score > 0),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id, catalog_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc)"""


def search_index(spark, sf):
    """The postings by impact and the catalogs' statistics, written once per input folder."""
    key = sf.rstrip("/")
    toks = written_table(spark, ("fts", "tokens", key), lambda: search.token_table(records.datasets(spark, sf)))
    stats = written_table(spark, ("fts", "stats", key), lambda: search.fts_stats(toks))
    df = written_table(spark, ("fts", "term_df", key), lambda: search.fts_term_df(toks))

    def write(folder: str) -> None:
        search.write_impacts({"terms": search.fts_terms(toks), "term_df": df, "stats": stats}, folder)
    path = written_folder(spark, ("fts", "impacts", key), write)
    return {"stats": stats, **search.read_impacts(spark, path)}


@query("bm25_search")
def q_bm25_search(spark, sf):
    r = search.bm25_topk(search_index(spark, sf), qterms_for(spark, sf))
    return r.select("query_id", "catalog_id", "id", F.round("score", 6).alias("score"),
                    F.col("rank").cast("bigint").alias("rank"))


oracle("bm25_search", f"""WITH {BM25_SQL}
SELECT query_id, catalog_id, id, round(score, 6) AS score, rank FROM bm WHERE rank <= {L.DEFAULT_FTS_LIMIT}""",
       *FTS_VIEWS)


def _like_sql(alias="d"):
    parts = []
    for qid, q in SEARCH_QUERIES:
        terms = search.like_terms(q)
        if not terms:
            continue
        conds = " OR ".join(f"lower({alias}.{f}) LIKE '%{t}%'" for t in terms for f in search.FIELDS)
        parts.append(f"SELECT {qid} AS query_id, {alias}.catalog_id, {alias}.id, CAST({float(len(terms))!r} AS DOUBLE) AS score "
                     f"FROM docs {alias} WHERE {conds}")
    return " UNION ALL ".join(parts)


LIKE_SQL = f"""lk0 AS ({_like_sql()}),
lk AS (SELECT *, row_number() OVER (PARTITION BY query_id, catalog_id ORDER BY id) AS rank FROM lk0)"""


@query("like_fallback")
def q_like_fallback(spark, sf):
    r = search.like_fallback(records.datasets(spark, sf), SEARCH_QUERIES)
    return r.select("query_id", "catalog_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


oracle("like_fallback", f"""WITH {INDEX_SQL}, {LIKE_SQL}
SELECT query_id, catalog_id, id, score, rank FROM lk WHERE rank <= {L.DEFAULT_FTS_LIMIT}""", "v_datasets")

# ------------------------------------------------------------------ hybrid (text mode) with post-filters
HYBRID_LIMIT = 10
HYBRID_FILTERS = {"organization": "org 1", "fmt": "csv", "tags": ["EN"]}


def fts_lists(spark, sf, fetch):
    ds = records.datasets(spark, sf)
    return search.fts_search(ds, search_index(spark, sf), qterms_for(spark, sf), SEARCH_QUERIES, fetch)


@query("hybrid_search")
def q_hybrid_search(spark, sf):
    lists = fts_lists(spark, sf, HYBRID_LIMIT * L.OVERFETCH_FACTOR)
    r = search.hybrid_search(lists, records.datasets(spark, sf), records.resources(spark, sf),
                             HYBRID_LIMIT, **HYBRID_FILTERS)
    return r.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"),
                    F.lit("fts").alias("mode"))


_FETCH = HYBRID_LIMIT * L.OVERFETCH_FACTOR
oracle("hybrid_search", f"""WITH {BM25_SQL}, {LIKE_SQL},
lex AS (SELECT query_id, catalog_id, id, score FROM bm WHERE rank <= {_FETCH}),
fb AS (SELECT query_id, catalog_id, id, score FROM lk WHERE rank <= {_FETCH}
       AND (query_id, catalog_id) NOT IN (SELECT query_id, catalog_id FROM lex)),
per AS (SELECT * FROM lex UNION ALL SELECT * FROM fb),
mg AS (SELECT query_id, id, max(score) AS score FROM per GROUP BY query_id, id),
rs AS (SELECT mg.*, d.organization, d.tags_text FROM mg JOIN v_datasets d ON mg.id = d.id
  WHERE d.organization IS NOT NULL AND contains(lower(d.organization), 'org 1')
    AND EXISTS (SELECT 1 FROM v_resources r WHERE r.dataset_id = d.id AND lower(r.format) = 'csv')
    AND list_contains(coalesce(list_transform(string_split(d.tags_text, ' '), lambda t: lower(t)), []), 'en')),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM rs)
SELECT query_id, id, round(score, 6) AS score, rank, 'fts' AS mode FROM rk WHERE rank <= {HYBRID_LIMIT}""",
       "v_datasets", "v_catalogs", "v_resources")

# ------------------------------------------------------------------ filters


@query("filter_organization")
def q_filter_organization(spark, sf):
    return search.filter_organization(records.datasets(spark, sf), "ORG 1").select("id", "organization")


oracle("filter_organization", """SELECT id, organization FROM v_datasets
WHERE organization IS NOT NULL AND contains(lower(organization), 'org 1')""", "v_datasets")


@query("filter_format")
def q_filter_format(spark, sf):
    return search.filter_format(records.datasets(spark, sf), records.resources(spark, sf), "Json").select("id")


oracle("filter_format", """SELECT id FROM v_datasets d
WHERE EXISTS (SELECT 1 FROM v_resources r WHERE r.dataset_id = d.id AND lower(r.format) = 'json')""", "v_resources")


@query("filter_tags_all")
def q_filter_tags_all(spark, sf):
    return search.filter_tags_all(records.datasets(spark, sf), ["EN", "Topic3"]) \
        .select("id", F.array_join("tags", " ").alias("tags"))


oracle("filter_tags_all", """SELECT id, tags_text AS tags FROM v_datasets
WHERE list_contains(list_transform(string_split(tags_text, ' '), lambda t: lower(t)), 'en')
  AND list_contains(list_transform(string_split(tags_text, ' '), lambda t: lower(t)), 'topic3')""", "v_datasets")

# ------------------------------------------------------------------ document text


@query("build_document")
def q_build_document(spark, sf):
    return documents.build_documents(records.datasets(spark, sf), records.resources(spark, sf))


DOC_SQL = """fm AS (SELECT dataset_id, upper(format) AS f, min(i) AS first_i FROM v_resources GROUP BY dataset_id, upper(format)),
fl AS (SELECT dataset_id, string_agg(f, ', ' ORDER BY first_i) AS formats FROM fm GROUP BY dataset_id),
parts AS (SELECT d.id, concat_ws('. ',
   CASE WHEN d.organization IS NOT NULL AND d.organization <> '' THEN 'Fuente: ' || d.organization END,
   'Título: ' || d.title,
   CASE WHEN d.tags_text IS NOT NULL THEN 'Tema: ' || replace(d.tags_text, ' ', ', ') END,
   CASE WHEN fl.formats IS NOT NULL THEN 'Formatos: ' || fl.formats END,
   CASE WHEN d.description IS NOT NULL AND d.description <> '' THEN 'Descripción: ' || d.description END) AS t
 FROM v_datasets d LEFT JOIN fl ON fl.dataset_id = d.id),
dtext AS (SELECT id, CASE WHEN ends_with(t, '.') THEN t ELSE t || '.' END AS document FROM parts)"""
oracle("build_document", f"WITH {DOC_SQL}\nSELECT id, document FROM dtext", "v_resources")

# ------------------------------------------------------------------ lookup and listing
LOOKUP_IDS = ["src3:3", "src5:105", "no-colon", "src9:999999", "src1:21"]
LOOKUP_CATALOG = "src4"


@query("dataset_lookup")
def q_dataset_lookup(spark, sf):
    """Records in a catalog store, looked up by id; each id opens its catalog's folder only."""
    ds = records.datasets(spark, sf).select("id", "title", "catalog_id")
    store = stores.CatalogStore(spark, scratch_path(spark, "lookup"), "id string, title string, catalog_id string")
    store.save(ds)
    wanted = {i.split(":", 1)[0] for i in LOOKUP_IDS if ":" in i} | {LOOKUP_CATALOG}
    return documents.lookup(store.load(sorted(wanted)), LOOKUP_IDS, LOOKUP_CATALOG) \
        .select("requested", "id", "catalog_id", "title")


oracle("dataset_lookup", f"""WITH req AS (SELECT unnest({"[" + ", ".join(repr(x) for x in LOOKUP_IDS) + "]"}) AS requested)
SELECT r.requested, d.id, d.catalog_id, d.title FROM req r JOIN v_datasets d
  ON contains(r.requested, ':') AND d.catalog_id = split_part(r.requested, ':', 1) AND d.id = r.requested
UNION ALL SELECT 'catalog:{LOOKUP_CATALOG}', id, catalog_id, title FROM v_datasets WHERE catalog_id = '{LOOKUP_CATALOG}'""",
       "v_datasets")


@query("dataset_list_page")
def q_dataset_list_page(spark, sf):
    s = pipeline.dataset_scores(spark, sf)
    r = ranking.dataset_list_page(s, "org 1", sort="overall", page=1)
    return r.select("id", "title", "organization", "overall")


oracle("dataset_list_page", f"""WITH {SCORES_CTES}
SELECT id, title, organization, overall FROM sc
WHERE contains(lower(coalesce(title, '')), 'org 1') OR contains(lower(coalesce(organization, '')), 'org 1')
   OR contains(lower(id), 'org 1')
ORDER BY overall DESC, id LIMIT {L.DATASET_PAGE_SIZE} OFFSET {L.DATASET_PAGE_SIZE}""", "v_datasets", "v_resources", "v_checks")
