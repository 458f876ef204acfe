"""Scans of files, catalog tables, JDBC databases and object stores."""
