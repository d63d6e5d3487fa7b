"""Relational operators: read models, versions, matching, catalogue upkeep, table geometry."""
