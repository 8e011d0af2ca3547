"""Composed plans over the adapter views, used by the query catalog."""
