"""Control flow over operators: the repair loop, the service, benchmarks, reports."""
