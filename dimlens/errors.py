"""Errors raised before a query runs."""


class DatasetError(ValueError):
    """A dataset, version, manifest or resource that cannot be used."""


class QueryError(ValueError):
    """A query that cannot be answered, with every problem found."""

    def __init__(self, problems):
        self.problems = [problems] if isinstance(problems, str) else list(problems)
        super().__init__("; ".join(self.problems))
