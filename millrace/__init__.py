"""millrace: DataFrame operators that turn text records into validated, matchable documents."""

__version__ = "0.1.0"
