"""Feature plans, matrix assembly and exploratory reports."""
