"""The queries of this package and, where SQL can express them, the same in SQL."""

from .ann import op10_ann
from .embedding_dedup import op3_embedding_dedup
from .language import op9_language
from .mixing import OP6_SQL, op6_mixing
from .ngram_join import op8_ngram_join
from .packing import op5_packing
from .sharding import OP2_SQL, op2_sharding
from .substring_dedup import op4_substring_dedup
from .toxicity import op7_toxicity
from .url_filters import OP1_SQL, op1_url_filter

QUERIES = {f.__name__: f for f in (op1_url_filter, op2_sharding, op3_embedding_dedup, op4_substring_dedup, op5_packing, op6_mixing, op7_toxicity, op8_ngram_join, op9_language, op10_ann)}
ORACLE_SQL = {"op1_url_filter": OP1_SQL, "op2_sharding": OP2_SQL, "op6_mixing": OP6_SQL}
