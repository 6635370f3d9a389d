"""Column functions: text, language, naming."""
