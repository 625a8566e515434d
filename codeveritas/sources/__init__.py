"""Readers that produce the ``files`` table and writers for reports."""
