"""What the library raises."""


class TidemarkError(Exception):
    pass


class Closed(TidemarkError):
    """The store was closed."""


class InvalidBucketWidth(TidemarkError, ValueError):
    """A bucket's width must be positive."""


class LateArrival(TidemarkError):
    """Strict admission met records older than the late-arrival window."""


class InvalidRecord(TidemarkError, ValueError):
    """A record lacks a field or doesn't fit the schema."""


class InvalidInput(TidemarkError, ValueError):
    """Lines to import are not well formed; nothing was appended."""


class CorruptLog(TidemarkError):
    """A commit file can't be read, or a file it names is missing."""


class Conflict(TidemarkError):
    """Files that a commit replaces are gone, by another commit."""


class OptionMismatch(TidemarkError, ValueError):
    """A store was opened with another partition duration than it was made with."""


class SealedWindow(TidemarkError):
    """Records of sealed windows were refused."""


class OrderViolation(TidemarkError):
    """A data file's rows are not in the order of time and source."""


class StreamMismatch(TidemarkError):
    """A stream's name belongs to another streaming query of this store."""
