"""Training-data operators: near-duplicate search, repeats, scoring, tokens and packing.

Nothing outside this folder imports it; queries.py registers one query per operator.
"""
