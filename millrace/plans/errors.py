"""Errors of the statement front end."""


class EngineError(Exception):
    """A statement that cannot be carried out."""


class ConstraintError(EngineError):
    """A row would break a constraint."""


class ConflictError(EngineError):
    """A transaction lost against one that committed first."""
