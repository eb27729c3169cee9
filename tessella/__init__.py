"""Quotient summaries of RDF graphs, and the operators around them, as Spark plans."""
