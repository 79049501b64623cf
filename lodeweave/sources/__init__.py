"""Tables and graph views that queries start from."""
