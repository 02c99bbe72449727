"""Queries and SQL of this subpackage."""

from __future__ import annotations

from .ann import op7_neighbours
from .clusters import ORACLE_SQL as CLUSTERS_SQL
from .clusters import op13_clusters
from .cws import op6_fingerprints
from .langid import op1_language_id
from .lines import op8_line_dedup
from .packing import op3_packing
from .passages import op9_passages
from .pieces import op5_sentencepiece
from .resampling import op11_resampling
from .secrets import ORACLE_SQL as SECRETS_SQL
from .secrets import op4_secrets
from .simhash import op2_simhash
from .urls import op10_url_filter
from .warc import ORACLE_SQL as WARC_SQL
from .warc import op12_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_secrets": op4_secrets,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_fingerprints": op6_fingerprints,
    "op7_neighbours": op7_neighbours,
    "op8_line_dedup": op8_line_dedup,
    "op9_passages": op9_passages,
    "op10_url_filter": op10_url_filter,
    "op11_resampling": op11_resampling,
    "op12_warc": op12_warc,
    "op13_clusters": op13_clusters,
}

ORACLE_SQL: dict[str, str] = {"op4_secrets": SECRETS_SQL, "op12_warc": WARC_SQL, "op13_clusters": CLUSTERS_SQL}
