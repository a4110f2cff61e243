"""Query normalisation and expansion (acronyms, synonyms) as Spark array
expressions over map literals built from the fixed language/acronym packs.

The packs are small fixed tables, so they travel inside the plan as literals;
no join, no shuffle. The pack applied to a row is chosen per row from its
catalog's language and country.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirador.functions import lookups as L
from mirador.functions.columns import normalize_text


def py_normalize(s: str) -> str:
    """Normalisation of fixed pack entries (lower, trim, NFD without marks)."""
    s = unicodedata.normalize("NFD", s.lower().strip())
    return "".join(ch for ch in s if not ("̀" <= ch <= "ͯ"))


def acronym_expansions(country: str) -> dict[str, list[str]]:
    pack = L.ACRONYMS.get(country, {})
    return {k: [w for w in py_normalize(v).split() if len(w) > 2] for k, v in pack.items()}


def synonym_expansions(language: str) -> dict[str, list[str]]:
    pack = L.SYNONYMS.get(language, {})
    return {py_normalize(k): [py_normalize(x) for x in v] for k, v in pack.items()}


def _map_literal(d: dict[str, list[str]]) -> Column:
    if not d:
        return F.create_map().cast("map<string,array<string>>")
    args = []
    for k, vs in d.items():
        args += [F.lit(k), F.array(*[F.lit(v) for v in vs])]
    return F.create_map(*args)


def _pick_map(key: Column, packs: dict[str, dict[str, list[str]]]) -> Column:
    expr = F.create_map().cast("map<string,array<string>>")
    for code, d in packs.items():
        expr = F.when(key == code, _map_literal(d)).otherwise(expr)
    return expr


def ws_split(c: Column) -> Column:
    return F.split(c, r"\s+")


def expand_acronyms(text: Column, country: Column) -> Column:
    """After each token whose upper form is an acronym, append its expansion words."""
    amap = _pick_map(country, {c: acronym_expansions(c) for c in L.ACRONYMS})
    toks = ws_split(text)
    out = F.flatten(F.transform(toks, lambda t: F.concat(
        F.array(t), F.coalesce(F.try_element_at(amap, F.upper(t)), F.array().cast("array<string>")))))
    return F.array_join(out, " ")


def expand_synonyms(text: Column, language: Column) -> Column:
    """After each token equal to a normalised key, append its normalised synonyms."""
    smap = _pick_map(language, {lang: synonym_expansions(lang) for lang in L.SYNONYMS})
    toks = ws_split(text)
    out = F.flatten(F.transform(toks, lambda t: F.concat(
        F.array(t), F.coalesce(F.try_element_at(smap, t), F.array().cast("array<string>")))))
    return F.array_join(out, " ")


def expand_query(text: Column, language: Column, country: Column) -> Column:
    """normalise -> acronyms -> synonyms -> distinct non-empty tokens in order (as a string)."""
    expanded = expand_synonyms(expand_acronyms(normalize_text(text), country), language)
    toks = F.filter(ws_split(expanded), lambda t: t != "")
    return F.array_join(F.array_distinct(toks), " ")
