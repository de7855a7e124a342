"""The registered queries of this subpackage and their DuckDB SQL."""

from .bpe import op8_bpe
from .chat import op7_chat
from .decontaminate import OP2_SQL, op2_decontaminate
from .embedding_dedup import OP1_SQL, op1_embedding_dedup
from .language import op5_language
from .lexical import OP12_SQL, op12_search
from .line_dedup import OP10_SQL, op10_line_dedup
from .minhash import op9_minhash
from .mixing import OP11_SQL, op11_mixing
from .ngram import op6_ngram
from .quality import op3_quality
from .repair import op13_repair
from .secrets import op4_secrets

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_language": op5_language,
    "op6_ngram": op6_ngram,
    "op7_chat": op7_chat,
    "op8_bpe": op8_bpe,
    "op9_minhash": op9_minhash,
    "op10_line_dedup": op10_line_dedup,
    "op11_mixing": op11_mixing,
    "op12_search": op12_search,
    "op13_repair": op13_repair,
}
ORACLE = {"op1_embedding_dedup": OP1_SQL, "op2_decontaminate": OP2_SQL, "op10_line_dedup": OP10_SQL, "op11_mixing": OP11_SQL, "op12_search": OP12_SQL}
