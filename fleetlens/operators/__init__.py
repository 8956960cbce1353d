"""DataFrame operators: extraction, diff, policy, tags, scores, reports."""
