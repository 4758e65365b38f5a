"""Query plans and the searches that run them."""
