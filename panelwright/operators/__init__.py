"""Operators over entity-period panels and dated event tables."""
