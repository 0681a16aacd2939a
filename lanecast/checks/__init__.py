"""Independent SQL for every registered report."""
