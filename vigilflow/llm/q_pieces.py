from .common import query, table
from .pieces import encode_decode, load

# Public vocabulary on the test box; a parameter of the operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query("op9_sentencepiece")
def op9_sentencepiece(spark, sf):
    """Ids of every document and whether decoding gives its text back."""
    return encode_decode(table(spark, sf, "documents"), load(MODEL))
