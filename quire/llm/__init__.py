"""Training-data operators: search, deduplication, language ID, tokens, WARC, chat and mixing.

Nothing outside this subpackage imports it.
"""
