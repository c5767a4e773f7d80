"""Reading tables from files, SQL and databases, and writing them."""
