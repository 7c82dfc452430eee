from pathlib import Path

import public_tokenizers

from .align import scored
from .common import query, table


@query("op12_token_alignment")
def op12_token_alignment(spark, sf):
    """Groups, links and pair counts of two tokenizers' tokens in every document."""
    a, b = (Path(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return scored(table(spark, sf, "documents"), a.read_text(encoding="utf-8"), b.read_bytes())
