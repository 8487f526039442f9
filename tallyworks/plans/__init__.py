"""Domain tables and the queries over them."""
