"""Training-data operators: ten corpus operators over documents, pages and embeddings.

Nothing outside this subpackage imports it.
"""
