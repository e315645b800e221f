"""DataFrame operators of the forecasting workload (each returns a lazy DataFrame
unless it must fit something, in which case the docstring says which jobs run)."""
