"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from .op01_sharding import op1_sharding
from .op02_toxicity import op2_toxicity
from .op03_html import op3_html
from .op04_mixing import op4_mixing
from .op05_minhash import op5_minhash
from .op06_quality import op6_quality
from .op07_media import op7_media
from .op08_secrets import op8_secrets
from .op09_decontamination import OP9_SQL, op9_decontamination
from .op10_substring_dedup import OP10_SQL, op10_substring_dedup
from .op11_resampling import OP11_SQL, op11_resampling
from .op12_conversations import OP12_SQL, op12_conversations
from .op13_simhash import op13_simhash


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_html": op3_html,
    "op4_mixing": op4_mixing,
    "op5_minhash": op5_minhash,
    "op6_quality": op6_quality,
    "op7_media": op7_media,
    "op8_secrets": op8_secrets,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_resampling": op11_resampling,
    "op12_conversations": op12_conversations,
    "op13_simhash": op13_simhash,
    "pipeline": pipeline,
}

SQL = {"op9_decontamination": OP9_SQL, "op10_substring_dedup": OP10_SQL, "op11_resampling": OP11_SQL, "op12_conversations": OP12_SQL}
