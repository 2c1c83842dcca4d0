"""Error classes of the table layer."""


class TableError(Exception):
    """Base of all below."""

    retryable = False


class InvalidArgument(TableError, ValueError):
    pass


class InvalidProperty(InvalidArgument):
    pass


class NotSupported(TableError, NotImplementedError):
    pass


class FileMissing(TableError, FileNotFoundError):
    pass


class PredicateError(InvalidArgument):
    pass


class CommitConflict(TableError):
    """The table changed since it was read."""


class RetriesExhausted(CommitConflict):
    retryable = True


class InjectedFault(TableError):
    """Raised by faults.inject() in tests."""
