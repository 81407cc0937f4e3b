"""Errors a caller can act on."""


class TableError(ValueError):
    """The input table cannot be used as given."""


class PlanError(ValueError):
    """A query plan is invalid for the table it is run on."""


class CleaningError(ValueError):
    """A cleaning plan cannot be applied."""


class ForecastError(ValueError):
    """A series cannot be forecast."""
