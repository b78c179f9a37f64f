"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from .common import table
from .decontamination import ORACLE_SQL as OP6_SQL
from .decontamination import op6_query
from .html_text import op9_query
from .jaccard_join import op4_query
from .language_id import op7_query
from .license_scan import ORACLE_SQL as OP10_SQL
from .license_scan import op10_query
from .packing import op1_query
from .pii import op5_query
from .quality import op3_query
from .token_files import op8_query
from .topk_search import ORACLE_SQL as OP2_SQL
from .topk_search import op2_query


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def queries():
    return {
        "op1_pack": lambda s, d: op1_query(_docs(s, d), vocabulary("word_bpe_49k.json")),
        "op2_topk_search": lambda s, d: op2_query(table(s, d, "embeddings")),
        "op3_quality": lambda s, d: op3_query(_docs(s, d), table(s, d, "labels")),
        "op4_jaccard_join": lambda s, d: op4_query(_docs(s, d)),
        "op5_pii": lambda s, d: op5_query(_docs(s, d)),
        "op6_decontaminate": lambda s, d: op6_query(_docs(s, d), table(s, d, "benchmark")),
        "op7_language_id": lambda s, d: op7_query(_docs(s, d)),
        "op8_token_files": lambda s, d: op8_query(s, _docs(s, d), vocabulary("byte_bpe_50k.json")),
        "op9_html_text": lambda s, d: op9_query(table(s, d, "pages")),
        "op10_license_scan": lambda s, d: op10_query(_docs(s, d)),
    }


def oracle_sql():
    return {"op2_topk_search": OP2_SQL, "op6_decontaminate": OP6_SQL, "op10_license_scan": OP10_SQL}
