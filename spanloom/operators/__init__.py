"""DataFrame operators on lines, spans, sections, scores, links and corpora."""
