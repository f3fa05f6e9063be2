from .syslog import read_syslog, marker_lines, MARKER, ORDER_COLUMNS

__all__ = ["read_syslog", "marker_lines", "MARKER", "ORDER_COLUMNS"]
