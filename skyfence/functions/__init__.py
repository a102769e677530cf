"""Column helpers shared by the table jobs."""
