"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP8_SQL, op8_chat
from .clustering import OP12_SQL, op12_clustering
from .conversation_repair import OP13_SQL, op13_conversation_repair
from .decontaminate import op3_decontaminate
from .embedding_dedup import OP9_SQL, op9_embedding_dedup
from .language import op6_language
from .minhash import op4_minhash
from .mixing import OP5_SQL, op5_mixing
from .pii import op7_pii
from .sharding import op10_sharding
from .suffix_dedup import op1_suffix_dedup
from .url_filter import OP11_SQL, op11_url_filter
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_warc": op2_warc,
    "op3_decontaminate": op3_decontaminate,
    "op4_minhash": op4_minhash,
    "op5_mixing": op5_mixing,
    "op6_language": op6_language,
    "op7_pii": op7_pii,
    "op8_chat": op8_chat,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_sharding": op10_sharding,
    "op11_url_filter": op11_url_filter,
    "op12_clustering": op12_clustering,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL = {
    "op2_warc": OP2_SQL,
    "op5_mixing": OP5_SQL,
    "op8_chat": OP8_SQL,
    "op9_embedding_dedup": OP9_SQL,
    "op11_url_filter": OP11_SQL,
    "op12_clustering": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
