"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from .chat import OP2_SQL, op2_chat_format
from .decontaminate import op10_decontaminate
from .filter_audit import OP13_SQL, op13_filter_audit
from .line_dedup import op3_line_dedup
from .mixing import OP7_SQL, op7_mixing
from .multi_index import op9_multi_index
from .ngram_join import op5_ngram_join
from .packing import op11_best_fit
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .secrets import op8_secret_scan
from .suffix_dedup import op4_suffix_dedup
from .toxicity import op1_toxicity
from .url_filter import op6_url_filter

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_chat_format, op3_line_dedup, op4_suffix_dedup, op5_ngram_join, op6_url_filter, op7_mixing, op8_secret_scan, op9_multi_index, op10_decontaminate, op11_best_fit, op12_prefix_trie, op13_filter_audit)}
ORACLE_SQL = {"op2_chat_format": OP2_SQL, "op7_mixing": OP7_SQL, "op12_prefix_trie": OP12_SQL, "op13_filter_audit": OP13_SQL}
