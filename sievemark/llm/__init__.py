"""Training-data operators: filtering, classification, dedup, decontamination, scoring, packing and output.

Nothing outside this package imports it; ``queries.py`` lists its registered queries.
"""
