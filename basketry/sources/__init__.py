from basketry.sources.tables import load_table, shop_frame, seg_frame, scored_frame, TABLES
from basketry.sources.files import (normalize_columns, normalize_name, coerce_numeric,
                                    scan_csv, write_csv, raw_header_frame, scan_parquet)

__all__ = ["load_table", "shop_frame", "seg_frame", "scored_frame", "TABLES",
           "normalize_columns", "normalize_name", "coerce_numeric", "scan_csv",
           "write_csv", "raw_header_frame", "scan_parquet"]
