from marketfeat.functions.numeric import array_round, clip, ieee_divide, ieee_ln, nonzero, rolling
from marketfeat.functions.text import (
    decode_entities,
    normalize_title,
    normalize_url,
    primary_label,
    python_strip,
    symbol_clean,
)

__all__ = [
    "array_round", "clip", "ieee_divide", "ieee_ln", "nonzero", "rolling",
    "decode_entities", "normalize_title", "normalize_url", "primary_label",
    "python_strip", "symbol_clean",
]
