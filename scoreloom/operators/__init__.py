"""DataFrame and Column operators over evaluation data."""
