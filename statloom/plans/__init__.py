"""Logical building blocks: global order, Gram aggregates, formulas, recipes, pipelines."""
