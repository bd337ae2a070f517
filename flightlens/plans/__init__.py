"""The domain tables, views and lookups, composed from the operators."""
