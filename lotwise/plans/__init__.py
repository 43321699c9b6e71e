"""Plans: operators put together into the jobs a user runs."""
