"""DataFrame operators. All are lazy unless they say that they materialise."""
