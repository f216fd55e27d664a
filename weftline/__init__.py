"""Weftline: supply-graph analytics and corpus preparation as Spark logical plans."""
