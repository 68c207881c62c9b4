"""Operators for preparing training data, one module each.

Nothing outside this package imports it.  ``registry`` lists the queries."""
