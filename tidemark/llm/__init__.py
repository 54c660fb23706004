"""Training-data operators: text, pages and vectors at corpus scale."""
