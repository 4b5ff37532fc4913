"""Column expressions: text, prompts, tokens, code, scores."""
