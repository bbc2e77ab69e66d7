"""Training-data operators: de-duplication, classification, mixing, language models, tokenizing."""
