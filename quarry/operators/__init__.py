"""Filters, projections, grouping and set algebra as DataFrame expressions."""
