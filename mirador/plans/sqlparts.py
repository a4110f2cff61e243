"""SQL fragments for the DuckDB oracles, written from the same fixed values."""

from __future__ import annotations

from mirador.fixtures import AS_OF
from mirador.functions import lookups as L
from mirador.functions.columns import freshness_lambda


def dbl(x: float) -> str:
    """A DOUBLE literal (DuckDB reads 0.15 as DECIMAL otherwise)."""
    return f"CAST({x!r} AS DOUBLE)"


def r3(expr: str) -> str:
    return f"(floor(({expr}) * 1000 + 0.5) / 1000)"


def avg3(expr: str) -> str:
    """Exact half-up mean of 3-decimal scores via integer thousandths."""
    s = f"sum(CAST(round({expr} * 1000) AS BIGINT))"
    n = f"count({expr})"
    return f"(CAST((2 * {s} + {n}) // (2 * {n}) AS BIGINT) / {dbl(1000.0)})"


def mean_exact(expr: str) -> str:
    return f"(sum(CAST(round({expr} * 1000) AS BIGINT)) / (count({expr}) * {dbl(1000.0)}))"


def trim_ws(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def format_score(expr: str) -> str:
    key = f"lower(trim({expr}))"
    whens = " ".join(f"WHEN '{k}' THEN {dbl(v)}" for k, v in L.FORMAT_SCORES.items())
    return f"(CASE {key} {whens} ELSE {dbl(L.DEFAULT_FORMAT_SCORE)} END)"


def format_key(expr: str) -> str:
    return f"upper(coalesce(nullif({expr}, ''), 'unknown'))"


def status_score(expr: str) -> str:
    redirects = ", ".join(str(s) for s in L.STATUS_REDIRECTS)
    return (f"(CASE WHEN {expr} >= 200 AND {expr} < 300 THEN {dbl(L.STATUS_OK_SCORE)} "
            f"WHEN {expr} IN ({redirects}) THEN {dbl(L.STATUS_REDIRECT_SCORE)} "
            f"WHEN {expr} = 403 THEN {dbl(L.STATUS_FORBIDDEN_SCORE)} "
            f"WHEN {expr} >= 500 THEN {dbl(L.STATUS_SERVER_ERROR_SCORE)} ELSE {dbl(0.0)} END)")


def level(expr: str) -> str:
    whens = " ".join(f"WHEN {expr} >= {dbl(t)} THEN '{n}'" for n, t in L.SCORE_LEVELS)
    return f"(CASE {whens} ELSE '{L.LOWEST_LEVEL}' END)"


def fold(expr: str) -> str:
    return f"translate(lower({expr}), '{L.ACCENTED}', '{L.UNACCENTED}')"


def tokens(expr: str) -> str:
    """Index tokens of one text as a DuckDB list."""
    cleaned = f"trim(regexp_replace({fold(f'coalesce({expr}, {chr(39)}{chr(39)})')}, '(\\.|[^a-z])+', ' ', 'g'))"
    return f"list_filter(string_split({cleaned}, ' '), lambda t: t <> '')"


AS_OF_TS = f"TIMESTAMP '{AS_OF}'"


def days_since(expr: str) -> str:
    return f"greatest({dbl(0.0)}, (epoch_us({AS_OF_TS}) - epoch_us({expr})) / {dbl(86400.0 * 1e6)})"


def freshness(expr: str) -> str:
    lam = -freshness_lambda()
    return (f"(CASE WHEN {expr} IS NULL THEN {dbl(0.0)} ELSE "
            f"{r3(f'least({dbl(1.0)}, exp({dbl(lam)} * {days_since(expr)}))')} END)")


def completeness_parts() -> dict[str, str]:
    def present(col):
        return f"length({trim_ws(col)}) > 0"
    return {
        "title": present("d.title"),
        "description": present("d.description"),
        "organization": present("d.organization"),
        "tags": "d.tags_text IS NOT NULL",
        "license": present("d.license"),
        "resources": "coalesce(rr.n_res, 0) > 0",
        "modifiedAt": "d.modified_on IS NOT NULL",
        "createdAt": "d.created_on IS NOT NULL",
    }


def completeness() -> str:
    p = completeness_parts()
    terms = []
    for name, w in L.COMPLETENESS_WEIGHTS:
        if name == "description":
            terms.append(f"(CASE WHEN {p[name]} THEN (CASE WHEN length({trim_ws('d.description')}) >= "
                         f"{L.MIN_DESCRIPTION_LENGTH} THEN {dbl(w)} ELSE {dbl(w / 2)} END) ELSE {dbl(0.0)} END)")
        else:
            terms.append(f"(CASE WHEN {p[name]} THEN {dbl(w)} ELSE {dbl(0.0)} END)")
    expr = dbl(0.0)
    for t in terms:
        expr = f"({expr} + {t})"
    return r3(expr)


def fields_list(present: bool) -> str:
    p = completeness_parts()
    items = []
    for name, _ in L.COMPLETENESS_WEIGHTS:
        cond = p[name] if present else f"NOT coalesce({p[name]}, false)"
        if present:
            cond = f"coalesce({cond}, false)"
        items.append(f"CASE WHEN {cond} THEN '{name}' END")
    return f"array_to_string(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL), ',')"


# Per-dataset score table as CTEs: latest, rf (resource facts), rr (rollup), sc (scores).
SCORES_CTES = f"""
latest AS (
  SELECT catalog_id, url, status, latency_ms, checked_at FROM (
    SELECT *, row_number() OVER (PARTITION BY catalog_id, url ORDER BY checked_at DESC, event_id DESC) AS rn
    FROM v_checks) WHERE rn = 1),
rf AS (
  SELECT r.dataset_id, r.catalog_id, r.i, r.url, r.format, r.size_bytes, l.status, l.latency_ms,
    {format_score("coalesce(nullif(r.format, ''), 'unknown')")} AS format_score,
    {format_key("r.format")} AS format_key,
    {status_score("l.status")} AS access_score
  FROM v_resources r LEFT JOIN latest l ON r.catalog_id = l.catalog_id AND r.url = l.url),
rbest AS (
  SELECT dataset_id, format_key AS best_format FROM (
    SELECT dataset_id, format_key, row_number() OVER (PARTITION BY dataset_id ORDER BY format_score DESC, i ASC) AS rn
    FROM rf) WHERE rn = 1),
rr AS (
  SELECT rf.dataset_id, count(*) AS n_res, sum(access_score) AS access_sum,
    sum(CASE WHEN access_score >= {dbl(L.ACCESSIBLE_MIN_SCORE)} THEN 1 ELSE 0 END) AS n_accessible,
    max(format_score) AS best_score, list_sort(list_distinct(list(format_key))) AS formats
  FROM rf GROUP BY rf.dataset_id),
sc0 AS (
  SELECT d.id, d.catalog_id, d.external_id, d.doc_id, d.title, d.organization,
    CAST(d.modified_on AS TIMESTAMP) AS modified_at,
    CASE WHEN coalesce(rr.n_res, 0) > 0 THEN {r3("rr.access_sum / rr.n_res")} ELSE {dbl(0.0)} END AS accessibility,
    coalesce(rr.best_score, {dbl(0.0)}) AS structure,
    {freshness("CAST(d.modified_on AS TIMESTAMP)")} AS freshness,
    {completeness()} AS completeness,
    CAST(coalesce(rr.n_res, 0) AS BIGINT) AS resource_count,
    CAST(coalesce(rr.n_res, 0) AS BIGINT) AS checked,
    CAST(coalesce(rr.n_accessible, 0) AS BIGINT) AS accessible,
    rb.best_format,
    coalesce(rr.formats, []) AS formats,
    CASE WHEN d.modified_on IS NOT NULL THEN CAST(floor({days_since("CAST(d.modified_on AS TIMESTAMP)")} + 0.5) AS BIGINT) END AS days_since_modified,
    CAST(length({trim_ws("d.description")}) AS BIGINT) AS description_length,
    CAST(CASE WHEN d.tags_text IS NULL THEN 0 ELSE len(string_split(d.tags_text, ' ')) END AS BIGINT) AS tag_count,
    {fields_list(True)} AS fields_present,
    {fields_list(False)} AS fields_missing
  FROM v_datasets d LEFT JOIN rr ON d.id = rr.dataset_id LEFT JOIN rbest rb ON d.id = rb.dataset_id),
sc AS (
  SELECT *, {r3(f"(((({dbl(0.0)} + completeness * {dbl(L.QUALITY_WEIGHTS['completeness'])}) + freshness * {dbl(L.QUALITY_WEIGHTS['freshness'])}) + structure * {dbl(L.QUALITY_WEIGHTS['structure'])}) + accessibility * {dbl(L.QUALITY_WEIGHTS['accessibility'])})")} AS overall
  FROM sc0)"""

SUMMARY_CTES = SCORES_CTES + f""",
known AS (SELECT catalog_id, count(*) AS known_count FROM v_datasets GROUP BY catalog_id),
summ AS (
  SELECT s.catalog_id, CAST(k.known_count AS BIGINT) AS dataset_count, count(*) AS datasets_scored,
    CAST(sum(len(formats)) AS BIGINT) AS resource_count,
    {avg3("overall")} AS overall, {avg3("accessibility")} AS accessibility,
    {avg3("structure")} AS structure, {avg3("freshness")} AS freshness,
    {avg3("completeness")} AS completeness,
    CASE WHEN sum(checked) > 0 THEN {r3("sum(accessible) / sum(checked)")} ELSE {dbl(0.0)} END AS accessible_pct,
    CASE WHEN k.known_count > 0 THEN {r3("count(*) / k.known_count")} ELSE {dbl(1.0)} END AS coverage
  FROM sc s JOIN known k ON s.catalog_id = k.catalog_id GROUP BY s.catalog_id, k.known_count),
idx AS (
  SELECT c.id, c.name, c.country, c.protocol, c.pos,
    CASE WHEN m.catalog_id IS NULL THEN 'pending' ELSE 'ok' END AS status,
    CAST(coalesce(m.dataset_count, 0) AS BIGINT) AS dataset_count,
    CAST(coalesce(m.resource_count, 0) AS BIGINT) AS resource_count,
    CAST(coalesce(m.datasets_scored, 0) AS BIGINT) AS datasets_scored,
    coalesce(m.overall, {dbl(0.0)}) AS overall, coalesce(m.accessibility, {dbl(0.0)}) AS accessibility,
    coalesce(m.structure, {dbl(0.0)}) AS structure, coalesce(m.freshness, {dbl(0.0)}) AS freshness,
    coalesce(m.completeness, {dbl(0.0)}) AS completeness, coalesce(m.accessible_pct, {dbl(0.0)}) AS accessible_pct,
    coalesce(m.coverage, {dbl(0.0)}) AS coverage
  FROM v_catalogs c LEFT JOIN summ m ON c.id = m.catalog_id)"""


# ------------------------------------------------------------------ search
def _str_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def map_literal(d: dict[str, list[str]]) -> str:
    if not d:
        return "NULL"
    return "MAP {" + ", ".join(f"'{k}': {_str_list(v)}" for k, v in d.items()) + "}"


def normalize(expr: str) -> str:
    return f"strip_accents(lower({trim_ws(expr)}))"


def expand_acronyms(text: str, cc: str) -> str:
    from mirador.functions import lookups as LL
    from mirador.operators.text import acronym_expansions
    cases = " ".join(f"WHEN {cc} = '{c}' THEN {map_literal(acronym_expansions(c))}[upper(t)]"
                     for c in LL.ACRONYMS)
    return (f"array_to_string(flatten(list_transform(string_split_regex({text}, '\\s+'), "
            f"lambda t: list_concat([t], coalesce(CASE {cases} END, [])))), ' ')")


def expand_synonyms(text: str, lang: str) -> str:
    from mirador.functions import lookups as LL
    from mirador.operators.text import synonym_expansions
    cases = " ".join(f"WHEN {lang} = '{g}' THEN {map_literal(synonym_expansions(g))}[t]" for g in LL.SYNONYMS)
    return (f"array_to_string(flatten(list_transform(string_split_regex({text}, '\\s+'), "
            f"lambda t: list_concat([t], coalesce(CASE {cases} END, [])))), ' ')")


def values_table(rows: list[tuple[int, str]], cols=("query_id", "query")) -> str:
    vals = ", ".join(f"({i}, '{q.replace(chr(39), chr(39) * 2)}')" for i, q in rows)
    return f"(SELECT * FROM (VALUES {vals}) t({', '.join(cols)}))"
