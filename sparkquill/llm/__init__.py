"""Training-data operators: ten corpus operators and the pipeline built on them."""
