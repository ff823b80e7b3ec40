"""The query catalogue on the sample tables, each with its SQL counterpart."""
