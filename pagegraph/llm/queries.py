"""The registered queries of this subpackage and their DuckDB oracles."""

from . import lines, topk, warc
from .jaccard import op7_token_group_join
from .lines import op8_line_dedup
from .lm import op9_subword_lattice
from .media import op4_avi_mjpeg
from .packing import op3_best_fit_packing
from .sharding import op10_stratified_sharding
from .topk import op1_term_topk
from .toxicity import op5_lexicon_toxicity
from .transducer import op6_bpe_transducer
from .warc import op2_warc_merkle

QUERIES = {f.__name__: f for f in (op1_term_topk, op2_warc_merkle, op3_best_fit_packing, op4_avi_mjpeg, op5_lexicon_toxicity, op6_bpe_transducer, op7_token_group_join, op8_line_dedup, op9_subword_lattice, op10_stratified_sharding)}
ORACLES = {"op1_term_topk": topk.ORACLE, "op2_warc_merkle": warc.ORACLE, "op8_line_dedup": lines.ORACLE}
