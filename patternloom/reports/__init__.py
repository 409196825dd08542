"""Human, markdown and JSON reports."""
