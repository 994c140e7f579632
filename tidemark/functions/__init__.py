"""Column functions and their plain counterparts."""

from tidemark.functions.text import format_bytes, format_rfc3339, parse_rfc3339, rfc3339, strict_base64, to_rfc3339

__all__ = ["format_bytes", "format_rfc3339", "parse_rfc3339", "rfc3339", "strict_base64", "to_rfc3339"]
