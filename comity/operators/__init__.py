"""DataFrame operators: scoring, verdicts, datasets, history, reports, evaluation."""
