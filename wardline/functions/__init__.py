"""Column functions and small DataFrame helpers shared by the operators."""

from wardline.functions.clock import ago, as_timestamp, within
from wardline.functions.identity import exception_id, quote_ident
from wardline.functions.masks import mask_date, mask_string
from wardline.functions.predicates import ilike_any, live, reads_object, touching
from wardline.functions.skew import lookup_join, measured_bytes, row_bytes, salted_join

__all__ = [
    "ago", "as_timestamp", "exception_id", "ilike_any", "live", "lookup_join", "mask_date", "mask_string",
    "measured_bytes", "quote_ident", "reads_object", "row_bytes", "salted_join", "touching", "within",
]
