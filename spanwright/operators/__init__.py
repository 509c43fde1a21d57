"""DataFrame operators: chunking, ranking, span algebra, redaction, evaluation."""
