"""Scans: state directories (CSV + parquet), gazette documents, and the driver-table fixtures."""
