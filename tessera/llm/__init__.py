"""Training-data operators: scoring, near-duplicate search, decontamination, mixing, sharding.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries and their SQL; each other module holds one operator.
"""
