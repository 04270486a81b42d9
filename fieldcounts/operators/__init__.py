"""Table operators: each is ``DataFrame -> DataFrame`` with no action inside."""
