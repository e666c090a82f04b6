"""Training-data operators; see ``registry`` for the queries built on them."""
