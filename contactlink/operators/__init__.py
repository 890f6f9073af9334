"""DataFrame operators: mapping, rules, blocking, matching, linking, clusters, reports."""
