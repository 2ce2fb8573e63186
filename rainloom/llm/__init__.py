"""Training-data operators over text, pages and media columns; nothing else in the library imports this."""
