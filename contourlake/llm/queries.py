"""The corpus operators' queries, with SQL where SQL can express them."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat_formatting
from .divergence import OP12_SQL, op12_source_divergence
from .lines import op8_line_dedup
from .media import op6_media_columns
from .ngram_join import op2_ngram_jaccard_join
from .packing import op7_packing
from .pieces import op4_sentencepiece, op9_token_counts
from .quality import op3_quality_rules
from .sharding import op10_sharding
from .substring import OP1_SQL, op1_substring_dedup
from .token_files import op11_token_files
from .whitening import op13_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_ngram_jaccard_join, op3_quality_rules, op4_sentencepiece, op5_chat_formatting, op6_media_columns, op7_packing, op8_line_dedup, op9_token_counts, op10_sharding, op11_token_files, op12_source_divergence, op13_embedding_whitening)}
ORACLES = {"op1_substring_dedup": OP1_SQL, "op5_chat_formatting": OP5_SQL, "op12_source_divergence": OP12_SQL}
