"""Where tables come from and statements go."""
