"""Training-data operators: Spark jobs over documents, pages, embeddings and conversations.

Nothing outside this subpackage imports it.
"""
