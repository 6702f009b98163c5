"""What can go wrong, one class for each kind."""


class GridloomError(Exception):
    """Base of all errors of this package."""


class UnsupportedFormatError(GridloomError):
    """The bytes are of no format that can be read, or use a part of it that can't."""


class VariableNotFoundError(GridloomError):
    """A variable was asked for that the source doesn't have."""


class SourceError(GridloomError):
    """The source can't be opened, or ends too early."""


class ExtractError(GridloomError):
    """The options of a query contradict each other or the source."""


class TrimError(GridloomError):
    """The options of a subset contradict each other or the source."""


class UnsupportedExportError(GridloomError):
    """The format can't hold the result."""


class UnsupportedCRSError(GridloomError):
    """A coordinate system outside the supported set."""

    def __init__(self, message: str, epsg: int | None = None, name: str | None = None):
        super().__init__(message)
        self.epsg, self.name = epsg, name
