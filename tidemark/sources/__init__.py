"""Records from and to other formats."""

from tidemark.sources.ndjson import export_lines, import_lines, parse_lines, write_ndjson
from tidemark.sources.tables import event_records, lineitem_records, order_records, single_record

__all__ = ["event_records", "export_lines", "import_lines", "lineitem_records", "order_records", "parse_lines", "single_record", "write_ndjson"]
