"""Queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from quillspark.llm.ann import op5_ann
from quillspark.llm.bpe import op2_bpe
from quillspark.llm.decontaminate import op7_decontaminate
from quillspark.llm.html_text import op4_html_text
from quillspark.llm.licences import op1_licences
from quillspark.llm.ngram_join import op3_ngram_join
from quillspark.llm.quality import op9_quality
from quillspark.llm.shards import op8_shards
from quillspark.llm.token_files import op6_token_files
from quillspark.llm.warc import op10_warc


def queries() -> dict[str, Callable]:
    return {
        "op1_licences": op1_licences,
        "op2_bpe": op2_bpe,
        "op3_ngram_join": op3_ngram_join,
        "op4_html_text": op4_html_text,
        "op5_ann": op5_ann,
        "op6_token_files": op6_token_files,
        "op7_decontaminate": op7_decontaminate,
        "op8_shards": op8_shards,
        "op9_quality": op9_quality,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {}
