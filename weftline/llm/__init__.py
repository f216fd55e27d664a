"""Training-data operators: packing, de-duplication, quality, PII, tokens, secrets, search, licences.

Nothing outside this package imports it; ``queries.QUERIES`` is what the entry
module adds when the package is present.
"""
