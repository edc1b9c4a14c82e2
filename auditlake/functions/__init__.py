"""Column functions; ``udfs`` holds the few that built-ins can't express."""
