"""The registered queries of the training-data operators and their SQL oracles."""

from mirador.llm.attribution import op9_token_attribution
from mirador.llm.bpe import op4_byte_bpe
from mirador.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from mirador.llm.line_dedup import op8_line_dedup
from mirador.llm.mixing import op1_mix_sources
from mirador.llm.nearest import OP6_SQL, op6_pivot_search
from mirador.llm.ngram_join import OP10_SQL, op10_ngram_jaccard
from mirador.llm.packing import op13_best_two_fit
from mirador.llm.passages import OP5_SQL, op5_line_hashing, op5_shared_passages
from mirador.llm.periodic import op11_periodic_runs
from mirador.llm.quality import op3_compression_bands
from mirador.llm.segments import OP5_UNITS_SQL, op5_unit_hashing
from mirador.llm.sharding import op2_kd_shards
from mirador.llm.urls import op7_url_filter

QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_kd_shards, op3_compression_bands, op4_byte_bpe, op5_unit_hashing,
    op5_line_hashing, op5_shared_passages, op6_pivot_search, op7_url_filter, op8_line_dedup, op9_token_attribution, op10_ngram_jaccard,
    op11_periodic_runs, op12_hard_negatives, op13_best_two_fit)}
# The others have no SQL form (seeded hashes, zstandard, tokenizers, a trained model, an edit join that is
# too slow in SQL over whole tables); tests compare them with brute force.
ORACLES = {"op5_unit_hashing": OP5_UNITS_SQL, "op5_line_hashing": OP5_SQL, "op6_pivot_search": OP6_SQL, "op10_ngram_jaccard": OP10_SQL, "op12_hard_negatives": OP12_SQL}
