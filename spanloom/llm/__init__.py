"""Training-data operators: search, language id, quality, dedup, tokenisation, scoring, mixing, URL and HTML."""
