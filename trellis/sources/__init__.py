"""Where graphs come from and results go."""
