"""Column functions: text, URLs, dates, HTML and JSON-LD."""
