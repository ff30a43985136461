"""Column functions: text normalisation, tokens, number words."""
