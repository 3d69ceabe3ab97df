"""The registered corpus queries, opN_<name>, each over its whole table."""

from __future__ import annotations

from .embedding_dedup import op6_embedding_dedup
from .license_scan import op2_license_scan
from .ngram_join import op4_ngram_jaccard_join
from .packing import op5_best_fit_packing
from .periodic_runs import op12_periodic_runs
from .quality_rules import op9_quality_rules
from .sentencepiece_codec import op3_sentencepiece
from .source_divergence import SQL as DIVERGENCE_SQL
from .source_divergence import op11_source_divergence
from .source_mixing import SQL as MIXING_SQL
from .source_mixing import op13_mixing_sources
from .span_dedup import op8_span_dedup
from .suffix_dedup import op1_suffix_dedup
from .toxicity import op10_toxicity
from .url_filter import op7_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_license_scan,
        op3_sentencepiece,
        op4_ngram_jaccard_join,
        op5_best_fit_packing,
        op6_embedding_dedup,
        op7_url_filter,
        op8_span_dedup,
        op9_quality_rules,
        op10_toxicity,
        op11_source_divergence,
        op12_periodic_runs,
        op13_mixing_sources,
    )
}
ORACLE: dict[str, str] = {"op11_source_divergence": DIVERGENCE_SQL, "op13_mixing_sources": MIXING_SQL}
