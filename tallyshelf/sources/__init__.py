from .clean import clean_text, normalize_keys, parse_month
from .raw_csv import read_raw_csv
from .tables import cut_lineage, read_table, shared_folder, write_table

__all__ = [
    "clean_text", "cut_lineage", "normalize_keys", "parse_month", "read_raw_csv", "read_table",
    "shared_folder", "write_table",
]
