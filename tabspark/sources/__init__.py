"""Reading, checking, stacking, writing and versioning tables."""

from .tables import concat_tables, load_table, rows_per_source, save_table, validate_source
from .versions import content_fingerprint, read_registry, register_version

__all__ = [
    "concat_tables",
    "content_fingerprint",
    "load_table",
    "read_registry",
    "register_version",
    "rows_per_source",
    "save_table",
    "validate_source",
]
