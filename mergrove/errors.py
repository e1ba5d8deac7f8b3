"""What can go wrong, as exceptions that callers can tell apart."""


class MergroveError(Exception):
    """Base of all."""


class IllegalArgument(MergroveError, ValueError):
    """An operator was given arguments that it cannot have."""


class NoStrategy(MergroveError, LookupError):
    """No registered strategy takes the operator under these flags."""


class ExprSyntaxError(MergroveError, ValueError):
    """A filter expression or a query text does not parse."""


class UnboundVariableError(MergroveError, ValueError):
    """A strict filter names a variable that nothing binds."""


class BadQuery(MergroveError, ValueError):
    """A query text that no endpoint could take."""


class WrongQueryType(BadQuery):
    """A graph query where rows are wanted, or the other way round."""


class UnacceptableConfiguration(MergroveError, ValueError):
    """A request asks for what its endpoint does not offer."""


class ServerError(MergroveError, RuntimeError):
    """An endpoint answered with an error status."""

    def __init__(self, status: int, message: str):
        super().__init__(f"status {status}: {message}")
        self.status = status

    def __reduce__(self):
        return type(self), (self.status, str(self).partition(": ")[2])


class MalformedResults(MergroveError, ValueError):
    """A results document breaks its format."""
