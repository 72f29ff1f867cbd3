"""Reusable DataFrame operators: joins, numbering, staging, columns, header matching."""
