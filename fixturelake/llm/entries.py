"""The queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from .chunks import op9_substring_dedup
from .decontam import op5_benchmark_decontamination
from .html import op3_html_extraction
from .jaccard import op1_ngram_jaccard_join
from .mixing import op7_source_mixing
from .pieces import op13_sentence_pieces
from .quality import QUALITY_BASE_SQL, op10_quality_rules, quality_base_columns
from .sharding import SHARD_COUNTS_SQL, op8_sharding, shard_counts
from .suffix import op2_suffix_array_dedup
from .tokens import op6_token_counts
from .toxicity import op4_toxicity
from .vafile import op12_centroid_clustering
from .variants import op11_spelling_variants

_ALL = (op1_ngram_jaccard_join, op2_suffix_array_dedup, op3_html_extraction, op4_toxicity, op5_benchmark_decontamination, op6_token_counts, op7_source_mixing, op8_sharding, op9_substring_dedup, op10_quality_rules, op11_spelling_variants, op12_centroid_clustering, op13_sentence_pieces, quality_base_columns, shard_counts)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {"quality_base_columns": QUALITY_BASE_SQL, "shard_counts": SHARD_COUNTS_SQL}
