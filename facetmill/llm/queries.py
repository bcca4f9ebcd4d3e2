"""Queries of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from . import convo_sql
from .convo_repair import op11_convo_repair
from .decontaminate import op9_decontaminate
from .fertility_rules import op13_fertility_rules
from .hnsw_dedup import op5_hnsw_dedup
from .html_extract import op2_html_extract
from .jaccard_join import op8_jaccard_join
from .mixing import op10_mixing
from .periodic_runs import op12_periodic_runs
from .quality_rules import op3_quality_rules
from .token_pack import op7_token_pack
from .toxicity import op4_toxicity
from .warc import op1_warc
from .wordbpe import op6_token_counts

QUERIES = {
    "op1_warc": op1_warc,
    "op2_html_extract": op2_html_extract,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_hnsw_dedup": op5_hnsw_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_token_pack": op7_token_pack,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontaminate": op9_decontaminate,
    "op10_mixing": op10_mixing,
    "op11_convo_repair": op11_convo_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_fertility_rules": op13_fertility_rules,
}

#: DuckDB: all pairs of one label, and the components that they reach.
_VECTORS = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach AS (SELECT r, r AS o FROM u UNION SELECT reach.r, b FROM reach JOIN pairs ON o = a),
least AS (SELECT reach.r AS r, min(v.vec_id) AS component FROM reach JOIN v ON v.r = reach.o GROUP BY ALL),
degrees AS (SELECT a AS r, count(*) AS n_links FROM pairs GROUP BY ALL)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id IS NOT DISTINCT FROM coalesce(component, vec_id) AS kept FROM v LEFT JOIN degrees USING (r) LEFT JOIN least USING (r)"""
ORACLES: dict[str, str] = {"op5_hnsw_dedup": _VECTORS, "op11_convo_repair": convo_sql.SQL}
