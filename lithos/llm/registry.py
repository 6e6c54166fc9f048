"""Queries of the training-data operators, one for each, and their equivalent SQL where there is one."""

from lithos.llm.exact_topk import OP5_SQL, op5_exact_topk
from lithos.llm.language_id import op8_language_id
from lithos.llm.minhash import op1_near_duplicates
from lithos.llm.mixing import OP6_SQL, op6_mixing
from lithos.llm.nn_descent import op9_neighbours
from lithos.llm.quality import op4_quality
from lithos.llm.repeats import op2_repeated_strings
from lithos.llm.sharding import op7_sharding
from lithos.llm.sp_bpe import op3_sentencepiece
from lithos.llm.token_store import op10_token_store

QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_repeated_strings, op3_sentencepiece, op4_quality, op5_exact_topk, op6_mixing, op7_sharding, op8_language_id, op9_neighbours, op10_token_store)}

ORACLE: dict[str, str] = {"op5_exact_topk": OP5_SQL, "op6_mixing": OP6_SQL}
