"""Fixed facts of the desk (services, forms, rules, portals) and the dimension tables built from them."""
