from pathlib import Path

import public_tokenizers

from .common import query, table
from .transducer import Vocabulary, token_counts


@query("op11_token_counts")
def op11_token_counts(spark, sf):
    """Bytes and tokens of every document."""
    definition = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    return token_counts(table(spark, sf, "documents"), Vocabulary(definition))
