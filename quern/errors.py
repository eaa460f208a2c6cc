"""Errors that the engine raises."""


class QuernError(Exception):
    """Base of all errors of the engine."""


class ParseError(QuernError):
    def __init__(self, message: str, at: int) -> None:
        super().__init__(f"{message} (at character {at})")
        self.at = at


class AnalysisError(QuernError):
    """A statement that parses but has no meaning for the tables at hand."""


class Unsupported(QuernError):
    """Something that another layer does here, such as Spark's cluster manager."""
