"""What calls can fail with."""


class EngineError(Exception):
    """Base of all of them."""


class Malformed(EngineError):
    """Input or stored data that breaks a rule."""


class PayloadTooLarge(EngineError):
    """A value or record above its limit."""


class WrongNamespaceKind(EngineError):
    """A log operation on a key/value namespace, or the reverse."""


class AuthFailed(EngineError):
    """Wrong password, or no such space: callers can't tell which."""


class ReadOnly(EngineError):
    """A write through a handle that was opened for reading."""


class Busy(EngineError):
    """Another writer holds the container or published first."""


class Cancelled(EngineError):
    """The caller's token was set."""
