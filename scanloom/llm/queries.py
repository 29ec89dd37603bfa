"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scanloom.llm.counts import op2_counts
from scanloom.llm.divergence import OP13_SQL, op13_divergence
from scanloom.llm.fingerprints import op12_fingerprints
from scanloom.llm.langid import op4_langid
from scanloom.llm.minhash import op5_minhash
from scanloom.llm.mixing import OP6_SQL, op6_mixing
from scanloom.llm.packing import op8_packing
from scanloom.llm.phrases import OP11_SQL, op11_phrases
from scanloom.llm.pseudo import op1_pseudo
from scanloom.llm.quality import op3_quality
from scanloom.llm.secret_scan import op9_secrets
from scanloom.llm.topk import OP7_SQL, op7_topk
from scanloom.llm.toxicity import op10_toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_pseudo, op2_counts, op3_quality, op4_langid, op5_minhash,
        op6_mixing, op7_topk, op8_packing, op9_secrets, op10_toxicity, op11_phrases,
        op12_fingerprints, op13_divergence,
    )
}
ORACLE: dict[str, str] = {"op6_mixing": OP6_SQL, "op7_topk": OP7_SQL, "op11_phrases": OP11_SQL, "op13_divergence": OP13_SQL}
