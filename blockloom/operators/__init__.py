"""DataFrame operators; column names are parameters, nothing here reads or collects."""
