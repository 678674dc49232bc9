"""Registered queries (one per operator) and the SQL that checks them."""
