"""DuckDB SQL oracles, one per registered query (same column names)."""

from __future__ import annotations

from mirador.fixtures import with_views
from mirador.plans.sqlparts import SCORES_CTES, SUMMARY_CTES, dbl, level, mean_exact

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, *views: str) -> None:
    ORACLES[name] = with_views(sql, *views)


SCORE_VIEWS = ("v_datasets", "v_resources", "v_checks")
INDEX_VIEWS = SCORE_VIEWS + ("v_catalogs",)

# ------------------------------------------------------------------ scoring
oracle("score_completeness", f"""WITH {SCORES_CTES}
SELECT id, catalog_id, completeness, fields_present, fields_missing, description_length, tag_count, resource_count FROM sc""",
       *SCORE_VIEWS)
oracle("score_freshness", f"WITH {SCORES_CTES}\nSELECT id, freshness, days_since_modified FROM sc", *SCORE_VIEWS)
oracle("score_structure", f"""WITH {SCORES_CTES}
SELECT id, structure, best_format, array_to_string(formats, ',') AS formats, resource_count FROM sc""", *SCORE_VIEWS)
oracle("score_accessibility", f"WITH {SCORES_CTES}\nSELECT id, accessibility, checked, accessible FROM sc",
       *SCORE_VIEWS)
oracle("score_overall", f"""WITH {SCORES_CTES}
SELECT id, catalog_id, accessibility, structure, freshness, completeness, overall FROM sc""", *SCORE_VIEWS)
oracle("score_level", f"""WITH {SCORES_CTES}
SELECT id, overall, {level("overall")} AS level, CAST(floor(overall * 100 + 0.5) AS BIGINT) AS percent FROM sc""",
       *SCORE_VIEWS)

# ------------------------------------------------------------------ summaries
oracle("catalog_summary", f"""WITH {SUMMARY_CTES}
SELECT catalog_id, dataset_count, datasets_scored, resource_count, overall, accessibility, structure, freshness,
 completeness, accessible_pct, coverage FROM summ""", *SCORE_VIEWS)
oracle("median_freshness", f"""WITH {SCORES_CTES}
SELECT catalog_id, CAST(median(days_since_modified) AS DOUBLE) AS median_freshness_days FROM sc GROUP BY catalog_id""",
       *SCORE_VIEWS)
oracle("top_formats", f"""WITH {SCORES_CTES},
fc AS (SELECT catalog_id, f AS format, count(*) AS datasets FROM (SELECT catalog_id, unnest(formats) AS f FROM sc)
       GROUP BY catalog_id, f),
rk AS (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY datasets DESC, format ASC) AS rank FROM fc)
SELECT catalog_id, format, CAST(datasets AS BIGINT) AS datasets, CAST(rank AS BIGINT) AS rank FROM rk WHERE rank <= 5""",
       *SCORE_VIEWS)
oracle("global_stats", f"""WITH {SUMMARY_CTES},
g AS (SELECT count(*) AS catalog_count, count(DISTINCT country) AS country_count,
  sum(CASE WHEN status <> 'pending' THEN 1 ELSE 0 END) AS n_scored,
  CAST(coalesce(sum(CASE WHEN status <> 'pending' THEN dataset_count END), 0) AS BIGINT) AS total_datasets,
  CAST(coalesce(sum(CASE WHEN status <> 'pending' THEN resource_count END), 0) AS BIGINT) AS total_resources,
  {mean_exact("CASE WHEN status <> 'pending' THEN overall END")} AS so,
  {mean_exact("CASE WHEN status <> 'pending' THEN accessibility END")} AS sa
  FROM idx)
SELECT catalog_count, country_count, total_datasets, total_resources,
 coalesce(round(so, 6), {dbl(0.0)}) AS avg_overall, coalesce(round(sa, 6), {dbl(0.0)}) AS avg_accessibility FROM g""",
       *INDEX_VIEWS)
oracle("weighted_rank", f"""WITH {SUMMARY_CTES}
SELECT id, country, dataset_count, overall, round(overall * log10(1 + dataset_count), 6) AS weight
FROM idx WHERE status <> 'pending' ORDER BY overall * log10(1 + dataset_count) DESC, pos ASC LIMIT 5""", *INDEX_VIEWS)
oracle("country_ranking", f"""WITH {SUMMARY_CTES},
w AS (SELECT *, overall * log10(1 + dataset_count) AS weight, CASE WHEN status = 'pending' THEN 1 ELSE 0 END AS is_pending FROM idx),
g AS (SELECT *, sum(1 - is_pending) OVER (PARTITION BY country) AS scored_count,
  sum(dataset_count) OVER (PARTITION BY country) AS total_datasets, min(pos) OVER (PARTITION BY country) AS first_pos FROM w),
o AS (SELECT *, row_number() OVER (ORDER BY scored_count DESC, total_datasets DESC, first_pos ASC, is_pending ASC, weight DESC, pos ASC) AS row_no,
  sum(1 - is_pending) OVER (ORDER BY scored_count DESC, total_datasets DESC, first_pos ASC, is_pending ASC, weight DESC, pos ASC
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM g)
SELECT country, id, status, CAST(scored_count AS BIGINT) AS scored_count, CAST(total_datasets AS BIGINT) AS total_datasets,
 CAST(row_no AS BIGINT) AS row_no, CAST(CASE WHEN is_pending = 0 THEN running END AS BIGINT) AS rank, round(weight, 6) AS weight FROM o""",
       *INDEX_VIEWS)
