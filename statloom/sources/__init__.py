"""Reading tables, shared folders, and models as JSON."""
