"""One module per numbered operator: a thin query with its production parameters."""
