"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from tessella.llm.ann import op9_nearest
from tessella.llm.bpe import op7_token_counts, op8_bpe
from tessella.llm.decontaminate import op10_decontaminate
from tessella.llm.lm import op5_lm_scores
from tessella.llm.paragraphs import op1_substring_dedup
from tessella.llm.quality import op4_quality
from tessella.llm.secrets import op6_secrets
from tessella.llm.simhash import op2_simhash
from tessella.llm.sql import NEAREST, SIMHASH, secrets_sql
from tessella.llm.warc import op3_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash": op2_simhash,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_lm_scores": op5_lm_scores,
    "op6_secrets": op6_secrets,
    "op7_token_counts": op7_token_counts,
    "op8_bpe": op8_bpe,
    "op9_nearest": op9_nearest,
    "op10_decontaminate": op10_decontaminate,
}
SQL = {"op2_simhash": SIMHASH, "op6_secrets": secrets_sql(), "op9_nearest": NEAREST}
