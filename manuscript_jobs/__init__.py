"""Spark jobs over large manuscript collections: layout, rules, checks, scores and corpus preparation."""
