"""Graph operators as DataFrame compositions."""
