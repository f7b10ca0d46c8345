"""Where the tables come from and where new table states go."""
