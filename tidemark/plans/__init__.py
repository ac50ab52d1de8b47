"""Domain views over stored tables, and the queries made of operators on them."""
