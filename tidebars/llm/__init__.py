"""Training-data operators over tables of documents, one module per operator."""
