"""Relational operators: joins, graph, ordering, filters, clouds."""
