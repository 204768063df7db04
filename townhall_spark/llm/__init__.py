"""Operators for large-scale training-data pipelines over documents, pages, chats and vectors."""
