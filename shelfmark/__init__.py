"""shelfmark: book-identifier cleansing and metadata enrichment on Spark.

Column functions (``shelfmark.functions``), sources (``shelfmark.sources``),
DataFrame operators (``shelfmark.operators``), sinks and registered queries
(``shelfmark.plans``) and streaming jobs (``shelfmark.streaming``).
"""

from .functions.isbn import classify_id, is_isbn10, is_isbn13, isbn10_to_13, normalize_id, trim_space
from .operators.providers import Provider, default_providers, parse_provider_a, parse_provider_b
from .operators.resolve import (attach, key_counts, lookup_table, resolve, resolve_keys, resolve_with_lookup,
                                save_lookup)
from .operators.validate import classify, rejected_ids, valid_ids

__all__ = [
    "classify_id", "is_isbn10", "is_isbn13", "isbn10_to_13", "normalize_id", "trim_space",
    "Provider", "default_providers", "parse_provider_a", "parse_provider_b",
    "attach", "key_counts", "lookup_table", "resolve", "resolve_keys", "resolve_with_lookup", "save_lookup",
    "classify", "rejected_ids", "valid_ids",
]
