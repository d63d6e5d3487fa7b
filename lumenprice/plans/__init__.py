"""Projections of the input tables, registered queries and the SQL that they must agree with."""
